"""Domain tables derived from the given ones, once as DataFrames and once as SQL for the oracle.

A paper is a vector with the document of the same number; its first line is the title. Labels 0-7 are the user's
corpus, 8 and 9 the candidates that a search found. Level-1 niches are the vectors' labels, level-2 areas the labels
modulo three. Reference lists come from order lines: the order's number names the paper, the part the reference, the
supplier the source that told it.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import signals as S
from quillgraph.functions.store import small
from quillgraph.functions.vectors import dot, mean_pool, unit

#: The clock of all queries: 2024-02-01.
AS_OF = 1706745600.0
AS_OF_YEAR = 2024
#: Similarity from which two papers are joined in the semantic layer of the queries.
SEMANTIC = 0.25
#: The text query of the reasoning queries.
QUESTION = "how does the drift of a thing relate to the heather model"
SURNAMES = ("Smith", "Jones", "Garcia", "Muller", "Dubois", "Rossi", "Chen", "Sato", "Silva", "Novak")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Layers that several queries read, by application, table version and name: written once, by the first query that asks.
_SHARED: dict[tuple, DataFrame] = {}


@dataclass
class Model:
    spark: SparkSession
    sf_dir: str

    @cached_property
    def version(self) -> tuple:
        """Sizes and times of the tables that the layers are made from: a changed table makes new layers."""
        paths = [self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.sf_dir}/{name}.parquet") for name in ("documents", "embeddings", "lineitem")]
        found = [(p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p) for p in paths]
        return tuple((fs.getContentSummary(p).getLength(), fs.getFileStatus(p).getModificationTime()) for fs, p in found)

    def shared(self, name: str, make: Callable[[], DataFrame], written: bool = False) -> DataFrame:
        """A layer as a written table, made once for each application and version of the tables. ``written``: by ``make``."""
        from quillgraph.functions.store import settled

        key = (self.spark.sparkContext.applicationId, self.sf_dir, self.version, name)
        if key not in _SHARED:
            _SHARED[key] = make() if written else settled(make(), name)
        return _SHARED[key]

    def table(self, name: str) -> DataFrame:
        return read(self.spark, self.sf_dir, name)

    @cached_property
    def papers(self) -> DataFrame:
        return self.shared("papers", self._papers)

    @cached_property
    def facts(self) -> DataFrame:
        """``papers`` without title and abstract, for all that reads no texts: those of the documents are neither shuffled nor written."""
        return self.shared("facts", lambda: self._papers().drop("title", "abstract"))

    def _papers(self) -> DataFrame:
        docs = self.table("documents").select("doc_id", "text")
        v = F.col("vec_id")
        number = v.cast("string")
        case = lambda *values: F.element_at(F.array(*[F.lit(x) for x in values]), (F.pmod(v, F.lit(len(values))) + 1).cast("int"))
        text = F.coalesce("text", F.lit(""))
        rating = F.when(F.pmod(v, F.lit(3)) == 0, (F.pmod(v, F.lit(10)) + 1).cast("double"))
        df = self.table("embeddings").join(docs, v == F.col("doc_id"), "left")
        df = df.select(
            F.concat(F.lit("p"), number).alias("paper_id"),
            v.alias("ordinal"),
            F.substring_index(text, "\n", 1).alias("title"),
            text.alias("abstract"),
            F.when(F.pmod(v, F.lit(13)) == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("A. "), case(*SURNAMES)))).alias("authors"),
            F.when(F.pmod(v, F.lit(17)) != 0, (F.pmod(v, F.lit(35)) + 1990).cast("int")).alias("year"),
            F.when(F.pmod(v, F.lit(4)) != 0, F.concat(F.lit("10.1234/doc."), F.lpad(number, 6, "0"))).otherwise("").alias("doi"),
            F.when(F.pmod(v, F.lit(5)) == 0, F.concat(F.lit("2101."), F.lpad(number, 6, "0"))).otherwise("").alias("arxiv_id"),
            F.when(F.pmod(v, F.lit(7)) < 4, F.concat(F.lit("s"), number)).otherwise("").alias("s2_id"),
            case("Journal of Synthetic Results", "Proceedings of the Test Conference", "", "arXiv preprint", "").alias("venue"),
            case("seed", "discovered", "snowball", "capsule").alias("source"),
            F.when(F.pmod(v, F.lit(29)) == 0, F.lit("note")).otherwise("paper").alias("kind"),
            F.when(F.pmod(v, F.lit(6)) != 0, F.pmod(v * 7, F.lit(300)).cast("int")).alias("cited_by_count"),
            rating.alias("user_rating"),
            F.when(rating.isNotNull(), F.lit(AS_OF) - F.pmod(v, F.lit(400)) * 86400.0).otherwise(0.0).alias("rated_at"),
            F.pmod(v, F.lit(4)).cast("int").alias("times_shown"),
            F.when(F.pmod(v, F.lit(8)) == 0, F.concat(F.lit("/library/"), number, F.lit(".pdf"))).otherwise("").alias("filepath"),
            F.array_compact(F.array(F.pmod(v, F.lit(50)), F.when(F.pmod(v, F.lit(2)) == 0, F.pmod(v * 3, F.lit(50))))).alias("source_ranks"),
            F.col("embedding").cast("array<double>").alias("embedding"),
            F.concat(F.lit("L1C"), F.col("label").cast("string")).alias("niche"),
            F.concat(F.lit("L2C"), F.pmod("label", F.lit(3)).cast("string")).alias("area"),
            F.when(F.col("label") >= 8, "candidate").otherwise("corpus").alias("role"),
        )
        df = df.withColumn("is_peer_reviewed", S.peer_review(F.col("arxiv_id"), F.col("doi"), F.col("venue")))
        decay = S.temporal_decay(F.col("rated_at"), AS_OF)
        return df.withColumn("weight", S.effective_weight(F.col("user_rating"), F.col("source"), decay, S.evidence_factor(F.col("source"), F.col("filepath") != "")))

    @cached_property
    def corpus(self) -> DataFrame:
        return self.papers.where("role = 'corpus'")

    @cached_property
    def candidates(self) -> DataFrame:
        return self.papers.where("role = 'candidate'")

    @cached_property
    def known(self) -> DataFrame:
        """``corpus`` without texts."""
        return self.facts.where("role = 'corpus'")

    @cached_property
    def found(self) -> DataFrame:
        """``candidates`` without texts."""
        return self.facts.where("role = 'candidate'")

    @cached_property
    def membership(self) -> DataFrame:
        """(paper_id, level, cluster_id) of the corpus."""
        levels = F.explode(F.array(F.struct(F.lit(1).alias("level"), F.col("niche").alias("cluster_id")), F.struct(F.lit(2).alias("level"), F.col("area").alias("cluster_id"))))
        return self.known.select("paper_id", levels.alias("m")).select("paper_id", "m.*")

    @cached_property
    def clusters(self) -> DataFrame:
        """(level, cluster_id, size, weight, high, centroid): centroids are unit means."""
        members = self.membership.join(self.known.select("paper_id", "embedding", "weight", "user_rating"), "paper_id").withColumn("one", F.lit(1.0))
        return self.shared("clusters", lambda: self._clusters(members))

    def _clusters(self, members: DataFrame) -> DataFrame:
        sums = members.groupBy("level", "cluster_id").agg(F.count("*").alias("size"), F.sum("weight").alias("weight"), F.sum((F.col("user_rating") >= 6).cast("int")).alias("high"))
        centroids = mean_pool(members, "embedding", "one", ["level", "cluster_id"]).withColumnRenamed("pooled", "centroid")
        return sums.join(centroids, ["level", "cluster_id"])

    @cached_property
    def sections(self) -> DataFrame:
        """(paper_id, section_type, vector): two or three section vectors for some papers."""
        half = F.concat(F.slice("embedding", 33, 32), F.slice("embedding", 1, 32))
        rule = lambda name, test, vector: F.when(test, F.struct(F.lit(name).alias("section_type"), vector.alias("vector")))
        o = F.col("ordinal")
        parts = F.array_compact(F.array(rule("methods", F.pmod(o, F.lit(2)) == 0, F.reverse("embedding")), rule("results", F.pmod(o, F.lit(3)) != 1, F.col("embedding")), rule("discussion", F.pmod(o, F.lit(4)) == 1, half)))
        return self.facts.select("paper_id", "ordinal", "role", "user_rating", "rated_at", F.explode(parts).alias("s")).select("paper_id", "ordinal", "role", "user_rating", "rated_at", "s.*")

    @cached_property
    def equations(self) -> DataFrame:
        half = F.concat(F.slice("embedding", 33, 32), F.slice("embedding", 1, 32))
        return self.facts.where("pmod(ordinal, 4) = 1 or pmod(ordinal, 6) = 3").select("paper_id", "role", "user_rating", "rated_at", half.alias("vector"))

    @cached_property
    def refs(self) -> DataFrame:
        """(paper_id, source, ref_id), distinct."""
        return self.shared("refs", self._refs)

    def _refs(self) -> DataFrame:
        n = self.table("embeddings").agg(F.count("*").alias("n"))
        # Numbers are shuffled, not names, and a paper's lines stay together, so that later groups of a paper need no rows of
        # other tasks. A name holds six digits of a part: parts of more that begin alike are one reference.
        lines = self.table("lineitem").select("l_orderkey", F.col("l_partkey").alias("part"), F.coalesce(F.pmod("l_suppkey", F.lit(3)), F.lit(2)).cast("int").alias("s")).crossJoin(F.broadcast(n))
        six = F.when(F.col("s") == 0, F.substring(F.col("part").cast("string"), 1, 6).cast("long")).otherwise(F.col("part"))
        lines = lines.select(F.pmod("l_orderkey", "n").alias("paper"), "s", six.alias("part")).repartition("paper").distinct()
        part = F.col("part").cast("string")
        return lines.select(
            F.concat(F.lit("p"), F.col("paper").cast("string")).alias("paper_id"),
            F.when(F.col("s") == 0, "crossref").when(F.col("s") == 1, "openalex").otherwise("s2").alias("source"),
            F.when(F.col("s") == 0, F.concat(F.lit("10.1234/doc."), F.lpad(part, 6, "0"))).when(F.col("s") == 1, F.concat(F.lit("W"), part)).otherwise(F.concat(F.lit("s"), part)).alias("ref_id"),
        )

    @cached_property
    def context(self) -> DataFrame:
        """One row: the user's context vector, from weighted papers, niches (half weight) and areas (quarter)."""
        papers = self.known.where("weight > 0").select("weight", "embedding")
        share = F.when(F.col("level") == 1, 0.5).otherwise(0.25)
        clusters = self.clusters.where("weight > 0").select((F.col("weight") * share).alias("weight"), F.col("centroid").alias("embedding"))
        return self.shared("context", lambda: mean_pool(papers.unionByName(clusters), "embedding", "weight").withColumnRenamed("pooled", "context"))

    @cached_property
    def question(self) -> DataFrame:
        """One row: the vector of the text query, the unit mean of what the user rated highest."""
        return mean_pool(self.corpus.where("user_rating >= 9").withColumn("one", F.lit(1.0)), "embedding", "one").withColumnRenamed("pooled", "question")

    @cached_property
    def semantic_edges(self) -> DataFrame:
        """(src, dst, weight), both directions, of corpus papers at least SEMANTIC alike."""
        from quillgraph.operators.similarity import similar_pairs

        def make() -> DataFrame:
            pairs = similar_pairs(self.known.select(F.col("paper_id").alias("id"), "embedding"), SEMANTIC)
            return pairs.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst"), "weight"), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"), "weight"))).alias("e")).select("e.*")

        return self.shared("semantic-edges", make)

    @cached_property
    def places(self) -> DataFrame:
        """(id, block, idx) of the corpus, for ``layers``."""
        from quillgraph.operators import layers

        return self.shared("places", lambda: layers.numbered(self.known.select(F.col("paper_id").alias("id")), self.refs), written=True)

    @cached_property
    def own_refs(self) -> DataFrame:
        return self.refs.join(small(self.known.select("paper_id")), "paper_id", "left_semi")

    @cached_property
    def direct_edges(self) -> DataFrame:
        """The direct citations of ``citation_edges``."""
        from quillgraph.operators.citations import direct_edges

        return self.shared("direct-edges", lambda: direct_edges(self.known, self.refs))

    def pairs(self, *columns: str, refs: bool = True, vectors: bool = True, threshold: float | None = SEMANTIC) -> DataFrame:
        """Pairs of corpus papers in all layers (``layers.pairs``), in one pass and not written: many times the papers."""
        from quillgraph.operators import layers

        embedded = self.known.select(F.col("paper_id").alias("id"), "embedding") if vectors else None
        return layers.pairs(self.places, self.own_refs if refs else None, embedded, threshold if vectors else None, self.direct_edges, columns)

    def alike(self, again: bool = False) -> DataFrame:
        """(a, b, sim) of ``semantic_edges``, not written."""
        from quillgraph.operators import layers

        vectors = self.known.select(F.col("paper_id").alias("id"), "embedding")
        return layers.pairs(layers.numbered(vectors.select("id")), vectors=vectors, threshold=SEMANTIC, columns=("a", "b", "sim"), again=again)

    def packed(self, overlay: bool) -> DataFrame:
        from quillgraph.operators import layers

        embedded = self.known.select(F.col("paper_id").alias("id"), "embedding")
        return self.shared(f"packed-{overlay}", lambda: layers.packed(self.places, self.own_refs, embedded, SEMANTIC, self.direct_edges, overlay), written=True)

    @cached_property
    def citation_edges(self) -> DataFrame:
        from quillgraph.operators.citations import coupled_edges

        return self.direct_edges.unionByName(coupled_edges(self.pairs("a", "b", "shared", "weight", "ab", "ba", vectors=False), self.refs))

    @cached_property
    def combined_edges(self) -> DataFrame:
        """(src, dst, weight, etype): both layers, citation attributes winning on shared pairs; each pair by itself."""
        edge = lambda a, b, w, kind: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), w.alias("weight"), F.lit(kind).alias("etype"))
        weight, alike = F.round("weight", 4), F.col("sim").isNotNull()
        kind = F.when(F.col("shared").isNotNull() & ~F.col("ab") & ~F.col("ba"), F.array(edge("a", "b", weight, "bib_coupling"), edge("b", "a", weight, "bib_coupling")))
        rest = F.array_compact(F.array(F.when(alike & ~F.col("ab"), edge("a", "b", F.col("sim"), "semantic")), F.when(alike & ~F.col("ba"), edge("b", "a", F.col("sim"), "semantic"))))
        made = self.pairs("a", "b", "sim", "shared", "weight", "ab", "ba").select(F.explode(F.coalesce(kind, rest)).alias("e")).select("e.*")
        return self.direct_edges.select("src", "dst", "weight", "etype").unionByName(made)


_PAPERS = f"""
papers as (
  select *, case when user_rating is not null then user_rating * case when rated_at <= 0 then 1.0 else greatest(0.25, pow(2.0, -({AS_OF} - rated_at) / 86400.0 / 90.0)) end
      when source = 'seed' then 5.0 else 0.0 end as weight,
    case when arxiv_id <> '' and doi = '' then false when lower(venue) like '%arxiv%' or lower(venue) like '%preprint%' then false
      when doi <> '' and arxiv_id = '' then true end as is_peer_reviewed
  from (
    select 'p' || vec_id as paper_id, vec_id as ordinal, split_part(coalesce(text, ''), chr(10), 1) as title, coalesce(text, '') as abstract,
      case when vec_id % 13 = 0 then cast([] as varchar[]) else ['A. ' || {list(SURNAMES)}[vec_id % 10 + 1]] end as authors,
      case when vec_id % 17 <> 0 then cast(vec_id % 35 + 1990 as integer) end as year,
      case when vec_id % 4 <> 0 then '10.1234/doc.' || lpad(cast(vec_id as varchar), 6, '0') else '' end as doi,
      case when vec_id % 5 = 0 then '2101.' || lpad(cast(vec_id as varchar), 6, '0') else '' end as arxiv_id,
      case when vec_id % 7 < 4 then 's' || vec_id else '' end as s2_id,
      ['Journal of Synthetic Results', 'Proceedings of the Test Conference', '', 'arXiv preprint', ''][vec_id % 5 + 1] as venue,
      ['seed', 'discovered', 'snowball', 'capsule'][vec_id % 4 + 1] as source,
      case when vec_id % 29 = 0 then 'note' else 'paper' end as kind,
      case when vec_id % 6 <> 0 then cast(vec_id * 7 % 300 as integer) end as cited_by_count,
      case when vec_id % 3 = 0 then cast(vec_id % 10 + 1 as double) end as user_rating,
      case when vec_id % 3 = 0 then {AS_OF} - vec_id % 400 * 86400.0 else 0.0 end as rated_at,
      cast(vec_id % 4 as integer) as times_shown,
      case when vec_id % 8 = 0 then '/library/' || vec_id || '.pdf' else '' end as filepath,
      case when vec_id % 2 = 0 then [vec_id % 50, vec_id * 3 % 50] else [vec_id % 50] end as source_ranks,
      cast(embedding as double[]) as embedding, 'L1C' || label as niche, 'L2C' || label % 3 as area,
      case when label >= 8 then 'candidate' else 'corpus' end as role
    from embeddings left join documents on doc_id = vec_id)
)""".strip()

_POOL = "list_transform(x, lambda v: v / sqrt(list_inner_product(x, x)))"

CTES: dict[str, tuple[str, tuple[str, ...]]] = {
    "papers": (_PAPERS, ()),
    "corpus": ("corpus as (select * from papers where role = 'corpus')", ("papers",)),
    "candidates": ("candidates as (select * from papers where role = 'candidate')", ("papers",)),
    "membership": ("membership as (select paper_id, 1 as level, niche as cluster_id from corpus union all select paper_id, 2, area from corpus)", ("corpus",)),
    "clusters": (
        f"""clusters as (
  select level, cluster_id, size, weight, high, {_POOL} as centroid from (
    select level, cluster_id, list(x order by i) as x from (
      select level, cluster_id, i, avg(x) as x from (select level, cluster_id, unnest(embedding) as x, generate_subscripts(embedding, 1) as i from membership join corpus using (paper_id)) group by all
    ) group by all
  ) join (
    select level, cluster_id, count(*) as size, sum(weight) as weight, sum(case when user_rating >= 6 then 1 else 0 end) as high from membership join corpus using (paper_id) group by all
  ) using (level, cluster_id))""",
        ("membership",),
    ),
    "sections": (
        """sections as (
  select paper_id, ordinal, role, user_rating, rated_at, 'methods' as section_type, list_reverse(embedding) as vector from papers where ordinal % 2 = 0
  union all select paper_id, ordinal, role, user_rating, rated_at, 'results', embedding from papers where ordinal % 3 <> 1
  union all select paper_id, ordinal, role, user_rating, rated_at, 'discussion', list_concat(embedding[33:64], embedding[1:32]) from papers where ordinal % 4 = 1)""",
        ("papers",),
    ),
    "equations": (
        "equations as (select paper_id, role, user_rating, rated_at, list_concat(embedding[33:64], embedding[1:32]) as vector from papers where ordinal % 4 = 1 or ordinal % 6 = 3)",
        ("papers",),
    ),
    "refs": (
        """refs as (
  select distinct 'p' || (l_orderkey % (select count(*) from embeddings)) as paper_id, case l_suppkey % 3 when 0 then 'crossref' when 1 then 'openalex' else 's2' end as source,
    case l_suppkey % 3 when 0 then '10.1234/doc.' || lpad(cast(l_partkey as varchar), 6, '0') when 1 then 'W' || l_partkey else 's' || l_partkey end as ref_id
  from lineitem)""",
        (),
    ),
    "context": (
        f"""context as (
  select {_POOL} as context from (select list(x order by i) as x from (
    select i, sum(w * x) / sum(w) as x from (
      select weight as w, unnest(embedding) as x, generate_subscripts(embedding, 1) as i from corpus where weight > 0
      union all select weight * case when level = 1 then 0.5 else 0.25 end, unnest(centroid), generate_subscripts(centroid, 1) from clusters where weight > 0
    ) group by i)))""",
        ("clusters",),
    ),
    "question": (
        f"question as (select {_POOL} as question from (select list(x order by i) as x from (select i, avg(x) as x from (select unnest(embedding) as x, generate_subscripts(embedding, 1) as i from corpus where user_rating >= 9) group by i)))",
        ("corpus",),
    ),
    "semantic_edges": (
        f"semantic_edges as (select a.paper_id as src, b.paper_id as dst, list_inner_product(a.embedding, b.embedding) as weight from corpus a join corpus b on a.paper_id <> b.paper_id where list_inner_product(a.embedding, b.embedding) >= {SEMANTIC})",
        ("corpus",),
    ),
    "source_counts": ("source_counts as (select paper_id, count(distinct source) as n_sources from refs group by paper_id)", ("refs",)),
    "corpus_refs": ("corpus_refs as (select distinct paper_id, ref_id from refs semi join corpus using (paper_id))", ("refs", "corpus")),
    "coupling": (
        """coupling as (
  select a.paper_id as a, b.paper_id as b, count(*) as shared, count(*) / sqrt(any_value(na.n) * any_value(nb.n)) as weight
  from corpus_refs a join corpus_refs b on a.ref_id = b.ref_id and a.paper_id < b.paper_id
    join (select paper_id, count(*) as n from corpus_refs group by all) na on na.paper_id = a.paper_id
    join (select paper_id, count(*) as n from corpus_refs group by all) nb on nb.paper_id = b.paper_id
  group by all)""",
        ("corpus_refs",),
    ),
    "direct": (
        """direct as (
  select r.paper_id as src, p.paper_id as dst, count(distinct r.source) as evidence from refs r semi join corpus c on c.paper_id = r.paper_id
  join corpus p on (r.source = 'crossref' and p.doi = r.ref_id) or (r.source = 's2' and p.s2_id = r.ref_id)
  where p.paper_id <> r.paper_id group by all)""",
        ("refs", "corpus"),
    ),
    "citation_edges": (
        """citation_edges as (
  select src, dst, 'citation' as etype, 1.0::double as weight, evidence, cast(null as bigint) as shared,
    round(least(0.99, least(1.0, 0.85 * case when least(coalesce(sa.n_sources, 1), coalesce(sb.n_sources, 1)) >= 3 then 1.5 when least(coalesce(sa.n_sources, 1), coalesce(sb.n_sources, 1)) >= 2 then 1.3 else 1.0 end) + 0.03 * (evidence - 1)) + 1e-9, 3) as confidence
  from direct left join source_counts sa on sa.paper_id = src left join source_counts sb on sb.paper_id = dst
  union all
  select u, v, 'bib_coupling', round(weight, 4), cast(null as bigint), shared,
    round(least(1.0, round(weight, 4) * case when least(coalesce(sa.n_sources, 1), coalesce(sb.n_sources, 1)) >= 3 then 1.5 when least(coalesce(sa.n_sources, 1), coalesce(sb.n_sources, 1)) >= 2 then 1.3 else 1.0 end) + 1e-9, 3)
  from (select a as u, b as v, weight, shared from coupling union all select b, a, weight, shared from coupling)
    left join source_counts sa on sa.paper_id = u left join source_counts sb on sb.paper_id = v
  where not exists (select 1 from direct d where (d.src = u and d.dst = v) or (d.src = v and d.dst = u)))""",
        ("direct", "coupling", "source_counts"),
    ),
    "combined_edges": (
        """combined_edges as (
  select coalesce(c.src, s.src) as src, coalesce(c.dst, s.dst) as dst, coalesce(c.weight, s.weight) as weight, coalesce(c.etype, 'semantic') as etype
  from semantic_edges s full join citation_edges c on c.src = s.src and c.dst = s.dst)""",
        ("semantic_edges", "citation_edges"),
    ),
}


def oracle(body: str, *names: str) -> str:
    """The body with the named tables' definitions, and what they need, before it."""
    if not names:
        return ("with recursive " if re.match(r"\s*\w+ as \(", body) else "") + body.strip()
    order: list[str] = []

    def add(name: str) -> None:
        for need in CTES[name][1]:
            add(need)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    more = re.match(r"\s*\w+ as \(", body) is not None  # the body begins with tables of its own
    return "with recursive " + ",\n".join(CTES[n][0] for n in order) + (",\n" if more else "\n") + body.strip()


__all__ = ["AS_OF", "AS_OF_YEAR", "CTES", "Model", "dot", "oracle", "unit"]
