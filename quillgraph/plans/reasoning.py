"""Queries that answer a text question over the corpus graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.operators import graph as G
from quillgraph.operators import layers as L
from quillgraph.operators import reasoning as A
from quillgraph.operators.ranking import PPR_ROUNDS
from quillgraph.plans.model import CTES, QUESTION, SEMANTIC, Model
from quillgraph.plans.registration import r6, registrar

QUERIES, ORACLES, query = registrar()

#: Floors of the queries; the given vectors are not clustered.
NICHE_FLOOR, BRIDGE_FLOOR, FRONTIER_FLOOR = -0.2, 0.0, 0.05

_WORDS = [w for w in QUESTION.lower().split() if w not in T.STOP_WORDS]
_PAIRS = [f"{a} {b}" for a, b in zip(_WORDS, _WORDS[1:], strict=False)]
_HITS = lambda where, what: "(" + " + ".join(f"contains({where}, '{w}')::int" for w in what) + ")"
_KEYWORD = f"least(1.0, {_HITS('t', _WORDS)} / {len(_WORDS)}.0::double * 0.5 + {_HITS('t', _PAIRS)} / {max(len(_PAIRS), 1)}.0::double * 0.25 + {_HITS('lower(title)', _WORDS)} / {len(_WORDS)}.0::double * 0.25)"

CTES["keyword"] = (f"keyword as (select paper_id, {_KEYWORD} as keyword from (select paper_id, title, lower(title) || ' ' || lower(abstract) as t from corpus))", ("corpus",))
CTES["retrieved"] = (
    f"""cg_outs as (select src, sum(weight) as t from combined_edges group by src),
cg_base as (select paper_id as id, t is null as dangling, count(*) over () as n from corpus left join cg_outs on src = paper_id),
cg_walk as (select id, 1.0::double / n as r, 0 as it from cg_base union all
  select b.id, 0.85 * (coalesce(f.flow, 0) + l.lost / b.n) + 0.15 / b.n, l.it + 1 from cg_base b
    cross join (select coalesce(sum(case when dangling then r end), 0) as lost, max(it) as it from cg_walk join cg_base using (id)) l
    left join (select dst, sum(r * weight / t) as flow from cg_walk w0 join combined_edges a on a.src = w0.id join cg_outs o on o.src = a.src group by dst) f on f.dst = b.id where l.it < {PPR_ROUNDS}),
cg_rank as (select id, r / max(r) over () as centrality from cg_walk where it = {PPR_ROUNDS}),
cg_degree as (select paper_id as id, count(e) as degree from corpus left join (select src as e from combined_edges union all select dst from combined_edges) on e = paper_id group by paper_id),
cg_facts as (select count(*) as n, greatest(0.02, 0.15 * (1 - sum(degree) / count(*) / greatest(count(*) - 1, 1))) as w, list(degree order by degree desc)[greatest(0, count(*) // 5 - 1) + 1] as hub from cg_degree),
retrieved as (
  select paper_id, list_inner_product(embedding, question) as sim, keyword, centrality, degree, case when degree >= hub then 'hub' when degree = 0 then 'isolated' else 'connected' end as role,
    (1 - w) * 0.55 * list_inner_product(embedding, question) + (1 - w) * 0.45 * keyword + w * centrality as blended
  from corpus join keyword using (paper_id) join cg_rank on cg_rank.id = paper_id join cg_degree on cg_degree.id = paper_id, question, cg_facts),
shown as (select * from (select r.*, title, year, row_number() over (order by round(blended, 9) desc, paper_id) as rank from retrieved r join corpus using (paper_id)) where rank <= 10)""",
    ("corpus", "keyword", "combined_edges", "question"),
)
CTES["matched"] = (
    f"matched as (select cluster_id, size, list_inner_product(centroid, question) as similarity, centroid from clusters, question where level = 1 and list_inner_product(centroid, question) >= {NICHE_FLOOR} qualify row_number() over (order by round(list_inner_product(centroid, question), 9) desc, cluster_id) <= 4)",
    ("clusters", "question"),
)


def found(m: Model) -> DataFrame:
    ranks = m.shared("centrality", lambda: L.walk(m.places, m.packed(overlay=True), rounds=PPR_ROUNDS))
    return A.retrieved(m.corpus, m.question, QUESTION, None, ranks)


def shown(m: Model) -> DataFrame:
    return G.settled(A.answers(found(m)).join(m.corpus.select("paper_id", "title", "year"), "paper_id"), "shown")


def among(m: Model, shown: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(src, dst) of the citation and of the semantic layer among a few shown papers; the other pairs are not made."""
    from quillgraph.operators.citations import coupling
    from quillgraph.operators.similarity import similar_pairs

    few = F.broadcast(shown.select("paper_id"))
    cited = G.induced(m.direct_edges.select("src", "dst"), few.select(F.col("paper_id").alias("id")))
    coupled = coupling(m.refs.join(few, "paper_id", "left_semi")).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    alike = similar_pairs(m.corpus.join(few, "paper_id", "left_semi").select(F.col("paper_id").alias("id"), "embedding"), SEMANTIC)
    return cited.unionByName(coupled), alike.select(F.col("a").alias("src"), F.col("b").alias("dst"))


def matched(m: Model) -> DataFrame:
    from quillgraph.functions.vectors import dot

    near = m.clusters.where("level = 1").crossJoin(F.broadcast(m.question)).withColumn("similarity", dot("centroid", "question")).where(F.col("similarity") >= NICHE_FLOOR)
    return near.orderBy(F.desc(F.round("similarity", 9)), "cluster_id").limit(4)


@query("select paper_id, round(keyword, 6) as keyword from keyword", "keyword")
def keyword_scores(m: Model) -> DataFrame:
    """SIG-28"""
    return m.corpus.select("paper_id", r6(T.keyword_score(QUESTION, F.col("title"), F.col("abstract")), "keyword"))


@query("select paper_id, round(blended, 6) as blended, round(sim, 6) as sim, round(keyword, 6) as keyword, round(centrality, 6) as centrality, degree, role from retrieved", "retrieved")
def query_retrieval(m: Model) -> DataFrame:
    """WIN-05"""
    return found(m).select("paper_id", r6("blended"), r6("sim"), r6("keyword"), r6("centrality"), "degree", "role")


@query("select paper_id, rank, round(blended, 6) as blended, role from shown", "retrieved")
def query_answers(m: Model) -> DataFrame:
    """API-05: the ten papers shown"""
    return shown(m).select("paper_id", F.col("rank").cast("long").alias("rank"), r6("blended"), "role")


@query(
    """inner_ as (select a.niche as cluster_id, count(*) as links from combined_edges e join corpus a on a.paper_id = e.src join corpus b on b.paper_id = e.dst where a.niche = b.niche and e.src <> e.dst group by 1),
    deg as (select id, count(*) as degree from (select src as id from combined_edges union all select dst from combined_edges) group by id),
    facts as (select niche as cluster_id, avg(year) as mean_year, max_by(paper_id, coalesce(degree, 0) * 1000000 - ordinal) as central from corpus left join deg on id = paper_id group by niche)
    select cluster_id, size, round(similarity, 6) as similarity, round(coalesce(links, 0) / (size * (size - 1.0)), 6)::double as density, round(mean_year, 6) as mean_year, central, case when mean_year >= 2020 then 'emerging' when mean_year >= 2010 then 'growing' else 'established' end as maturity
    from matched join facts using (cluster_id) left join inner_ using (cluster_id)""",
    "matched", "combined_edges", "corpus",
)
def niche_profiles(m: Model) -> DataFrame:
    """AGG-13"""
    p = A.niche_profiles(m.clusters, m.membership, m.corpus, m.question, m.combined_edges, NICHE_FLOOR)
    return p.select("cluster_id", "size", r6("similarity"), r6("density"), F.round("mean_year", 6).alias("mean_year"), "central", "maturity")


@query(
    """pairs as (select a.paper_id as a, b.paper_id as b from shown a join shown b on a.rank < b.rank)
    select a, b, 'edge' as kind, case when cited and alike then 'citation + semantic similarity' when cited then 'citation' else 'semantic similarity' end as detail from (
      select a, b, exists (select 1 from citation_edges c where (c.src = a and c.dst = b) or (c.src = b and c.dst = a)) as cited, exists (select 1 from semantic_edges c where (c.src = a and c.dst = b) or (c.src = b and c.dst = a)) as alike from pairs) where cited or alike
    union all select a, b, 'references', 'share ' || count(*) || ' reference(s)' from pairs join corpus_refs x on x.paper_id = a join corpus_refs y on y.paper_id = b and y.ref_id = x.ref_id group by a, b
    union all select a, b, 'niche', 'same niche (' || x.niche || ')' from pairs join corpus x on x.paper_id = a join corpus y on y.paper_id = b and x.niche = y.niche""",
    "retrieved", "citation_edges", "semantic_edges", "corpus_refs",
)
def paper_connections(m: Model) -> DataFrame:
    """JON-13"""
    found = shown(m)
    return A.connections(found, *among(m, found), m.refs, m.membership)


@query(
    f"""select paper_id, round(least, 6) as least from (select paper_id, min(list_inner_product(embedding, centroid)) as least from corpus, (select centroid from matched order by round(similarity, 9) desc, cluster_id limit 3) group by paper_id)
    where least > {BRIDGE_FLOOR} and paper_id not in (select paper_id from shown) qualify row_number() over (order by round(least, 9) desc, paper_id) <= 3""",
    "corpus", "matched", "retrieved",
)
def bridge_papers(m: Model) -> DataFrame:
    """JON-16: a top-3 report"""
    niches = matched(m).orderBy(F.desc(F.round("similarity", 9)), "cluster_id").limit(3)
    return A.bridges(m.corpus, niches, shown(m), BRIDGE_FLOOR).select("paper_id", r6("least"))


@query(
    f"""select paper_id, round(list_inner_product(embedding, question), 6) as sim from corpus left join (select id, count(*) as degree from (select src as id from semantic_edges union all select dst from semantic_edges) group by id) on id = paper_id, question
    where list_inner_product(embedding, question) >= {FRONTIER_FLOOR} and coalesce(degree, 0) <= 12 and paper_id not in (select paper_id from shown) qualify row_number() over (order by round(list_inner_product(embedding, question), 9) desc, paper_id) <= 3""",
    "corpus", "semantic_edges", "question", "retrieved",
)
def frontier_answers(m: Model) -> DataFrame:
    """JON-17: a top-3 report"""
    return A.frontier(m.corpus, m.question, shown(m), m.semantic_edges, FRONTIER_FLOOR, 12).select("paper_id", r6("sim"))


@query(
    """dated as (select * from shown where year is not null), decades as (select year // 10 * 10 as decade, count(*) as c from dated group by 1)
    select (select title from dated order by year, rank limit 1) as oldest, (select title from dated order by year desc, rank desc limit 1) as newest, (select max(year) - min(year) from dated) as span,
      (select case when c > (select count(*) from dated) * 0.5 then decade end from decades order by c desc, decade limit 1) as peak""",
    "retrieved",
)
def temporal_narrative(m: Model) -> DataFrame:
    """AGG-14"""
    return A.narrative(shown(m))


@query("select case when max(blended) is null then 'empty' when max(blended) < 0.3 then 'barely covered' when max(blended) < 0.5 then 'tangential' else '' end as note from shown", "retrieved")
def coverage_note(m: Model) -> DataFrame:
    """AGG-15"""
    return shown(m).agg(F.max("blended").alias("b")).select(A.coverage_note(F.col("b")).alias("note"))


@query(
    """six as (select paper_id as id, rank from shown where rank <= 6),
    walks as (select id as source, id, 0 as hops from six union select source, d.dst, hops + 1 from walks join direct d on d.src = walks.id where hops < 4)
    select case when s.rank < t.rank then s.id else t.id end as a, case when s.rank < t.rank then t.id else s.id end as b, min(hops) as hops from walks join six s on s.id = source join six t on t.id = walks.id where hops > 0 and s.id <> t.id group by 1, 2""",
    "retrieved", "direct",
)
def citation_lineages(m: Model) -> DataFrame:
    """WIN-19"""
    return A.lineages(shown(m), m.direct_edges.select("src", "dst")).where("a <> b")


@query(
    """older as (select d.src, d.dst from direct d join corpus a on a.paper_id = d.src join corpus b on b.paper_id = d.dst where b.year < a.year),
    walks as (select paper_id as id, 0 as level from corpus union select o.src, level + 1 from walks join older o on o.dst = walks.id)
    select id as paper_id, max(level) as level from walks group by id""",
    "direct", "corpus",
)
def influence_levels(m: Model) -> DataFrame:
    """WIN-20: topological level of every paper along citations to older ones"""
    year = m.corpus.select("paper_id", "year")
    cites = m.direct_edges.select("src", "dst")
    older = cites.join(year.select(F.col("paper_id").alias("src"), F.col("year").alias("a")), "src").join(year.select(F.col("paper_id").alias("dst"), F.col("year").alias("b")), "dst").where("b < a")
    arcs = G.settled(older.select(F.col("dst").alias("src"), F.col("src").alias("dst")), "older")
    return G.topological_levels(arcs, m.corpus.select(F.col("paper_id").alias("id"))).select(F.col("id").alias("paper_id"), "level")


@query(
    """select s.paper_id as a, t.paper_id as b from shown s join shown t on s.rank < t.rank join corpus x on x.paper_id = s.paper_id join corpus y on y.paper_id = t.paper_id
    where exists (select 1 from citation_edges c where ((c.src = s.paper_id and c.dst = t.paper_id) or (c.src = t.paper_id and c.dst = s.paper_id)) and c.confidence < 0.1)""",
    "retrieved", "corpus", "citation_edges",
)
def doubtful_pairs(m: Model) -> DataFrame:
    """JON-18: pairs among the shown papers whose edge is in doubt"""
    ids = shown(m).select("paper_id", "rank")
    weak = G.undirected(m.citation_edges.where("confidence < 0.1").select("src", "dst", "weight")).select("a", "b")
    x, y = ids.select(F.col("paper_id").alias("p"), F.col("rank").alias("rp")), ids.select(F.col("paper_id").alias("q"), F.col("rank").alias("rq"))
    pairs = x.crossJoin(F.broadcast(y)).where("rp < rq")
    return pairs.join(weak, (F.least("p", "q") == F.col("a")) & (F.greatest("p", "q") == F.col("b"))).select(F.col("p").alias("a"), F.col("q").alias("b"))
