"""Queries over reference lists, coupling and citation edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.operators import citations as C
from quillgraph.plans.model import Model
from quillgraph.plans.registration import r6, registrar

QUERIES, ORACLES, query = registrar()


@query("select a, b, shared, round(weight, 6) as weight from coupling", "coupling")
def bibliographic_coupling(m: Model) -> DataFrame:
    """JON-03, SET-02"""
    return C.coupling(m.refs.join(m.corpus.select("paper_id"), "paper_id", "left_semi")).select("a", "b", "shared", r6("weight"))


@query(
    """select 'o' || a.l_orderkey as a, 'o' || b.l_orderkey as b, count(*) as shared
    from (select distinct l_orderkey, l_partkey from lineitem) a join (select distinct l_orderkey, l_partkey from lineitem) b on a.l_partkey = b.l_partkey and a.l_orderkey < b.l_orderkey
    group by all having count(*) >= 2"""
)
def order_coupling(m: Model) -> DataFrame:
    """JON-03 over all order lines: orders that share two parts or more"""
    lines = m.table("lineitem").select(F.col("l_orderkey").alias("o"), "l_partkey").distinct()
    pairs = lines.select(F.col("o").alias("x"), "l_partkey").join(lines.select(F.col("o").alias("y"), "l_partkey"), "l_partkey").where("x < y").groupBy("x", "y").agg(F.count("*").alias("shared")).where("shared >= 2")
    return pairs.select(F.concat(F.lit("o"), "x").alias("a"), F.concat(F.lit("o"), "y").alias("b"), "shared")


@query("select src, dst, evidence from direct", "direct")
def direct_citations(m: Model) -> DataFrame:
    """JON-08"""
    return C.direct_citations(m.corpus, m.refs)


@query("select src, dst, etype, weight, evidence, shared, cast(confidence as double) as confidence from (select * replace (weight::double as weight) from citation_edges)", "citation_edges")
def citation_edges(m: Model) -> DataFrame:
    """JON-09, JON-10"""
    return m.citation_edges


@query(
    """select d.src, d.dst, d.evidence, c.shared, round(c.weight, 4) as weight from direct d join coupling c on c.a = least(d.src, d.dst) and c.b = greatest(d.src, d.dst)""", "direct", "coupling"
)
def coupled_citations(m: Model) -> DataFrame:
    """JON-10: direct citations annotated with the coupling of their ends"""
    direct = C.direct_citations(m.corpus, m.refs).withColumn("a", F.least("src", "dst")).withColumn("b", F.greatest("src", "dst"))
    pairs = C.coupling(m.refs.join(m.corpus.select("paper_id"), "paper_id", "left_semi"))
    return direct.join(pairs, ["a", "b"]).select("src", "dst", "evidence", "shared", F.round("weight", 4).alias("weight"))


@query(
    "select paper_id, source, n_refs from (select *, row_number() over (partition by paper_id order by case source when 'crossref' then 1 when 'openalex' then 2 else 3 end) as rn from (select paper_id, source, count(distinct ref_id) as n_refs from refs group by all)) where rn = 1",
    "refs",
)
def reference_cascade(m: Model) -> DataFrame:
    """SRC-15"""
    return C.first_source(m.refs)


@query(
    "select paper_id, n_sources, n_refs, n_multi from (select paper_id, count(distinct source) as n_sources from refs group by all) join (select paper_id, count(*) as n_refs, cast(sum(case when k > 1 then 1 else 0 end) as bigint) as n_multi from (select paper_id, ref_id, count(distinct source) as k from refs group by all) group by all) using (paper_id)",
    "refs",
)
def merged_references(m: Model) -> DataFrame:
    """SRC-16, SET-01"""
    return C.merged_references(m.refs).select("paper_id", "n_sources", "n_refs", "n_multi")


@query("select case when source = 'crossref' then 'doi' else source end as ns, count(*) as n, count(distinct ref_id) as n_distinct from refs group by all", "refs")
def reference_namespaces(m: Model) -> DataFrame:
    """JON-08: kinds of identifiers"""
    named = m.refs.withColumn("ns", C.namespace(F.col("source"), F.col("ref_id")))
    return named.groupBy("ns").agg(F.count("*").alias("n"), F.count_distinct("ref_id").alias("n_distinct"))


@query(
    """select r.paper_id as src, p.paper_id as dst, count(*) as mentions from (select paper_id, lower(title) as t from papers) r join (
      select paper_id, regexp_replace(lower(title), '[^a-z0-9]+', '', 'g') as k, ordinal, row_number() over (partition by regexp_replace(lower(title), '[^a-z0-9]+', '', 'g') order by ordinal) as rn from corpus) p
      on p.rn = 1 and p.k <> '' and p.k = regexp_replace(r.t, '[^a-z0-9]+', '', 'g') and r.paper_id <> p.paper_id group by all""",
    "papers", "corpus",
)
def local_references(m: Model) -> DataFrame:
    """JON-11: references given by title only, matched on letters and digits"""
    key = F.regexp_replace(F.lower("title"), "[^a-z0-9]+", "")
    known = m.corpus.select("paper_id", "ordinal", key.alias("k")).where("k <> ''").groupBy("k").agg(F.min_by("paper_id", "ordinal").alias("dst"))
    return m.papers.select(F.col("paper_id").alias("src"), key.alias("k")).join(known, "k").where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("mentions"))


@query("select src, dst, etype, round(weight, 6) as weight from (select src, dst, etype, weight::double as weight from combined_edges)", "combined_edges")
def combined_layer(m: Model) -> DataFrame:
    """JON-12"""
    return m.combined_edges.select("src", "dst", "etype", r6("weight"))


@query("select a, b, shared, round(weight, 6) as weight from (select *, row_number() over (order by round(weight, 9) desc, a, b) as rn from coupling) where rn <= 15", "coupling")
def top_coupled_pairs(m: Model) -> DataFrame:
    """AGG-23: a top-15 report"""
    pairs = C.coupling(m.refs.join(m.corpus.select("paper_id"), "paper_id", "left_semi"))
    return pairs.orderBy(F.desc(F.round("weight", 9)), "a", "b").limit(15).select("a", "b", "shared", r6("weight"))


@query("select id, degree, round(strength, 6) as strength from (select *, row_number() over (order by round(strength, 9) desc, id) as rn from (select src as id, count(*) as degree, sum(weight)::double as strength from citation_edges group by src)) where rn <= 10", "citation_edges")
def top_weighted_degree(m: Model) -> DataFrame:
    """AGG-23: a top-10 report"""
    d = m.citation_edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))
    return d.orderBy(F.desc(F.round("strength", 9)), "id").limit(10).select("id", "degree", r6("strength"))


@query(
    """select round(avg(confidence) + 1e-9, 4)::double as mean_edge_confidence, count(*) filter (confidence < 0.5) as low_conf_edges, round(count(*) filter (confidence < 0.5) / count(*) + 1e-9, 4) as low_conf_ratio, count(*) as edges,
      (select count(*) from source_counts semi join corpus using (paper_id)) as refs_with_sources, (select count(*) from source_counts semi join corpus using (paper_id) where n_sources >= 2) as refs_multi_source from citation_edges""",
    "citation_edges", "source_counts",
)
def reliability_snapshot(m: Model) -> DataFrame:
    """AGG-06"""
    low = F.col("confidence") < 0.5
    edges = m.citation_edges.agg(
        F.round(F.avg("confidence") + 1e-9, 4).alias("mean_edge_confidence"), F.count_if(low).alias("low_conf_edges"), F.round(F.count_if(low) / F.count("*") + 1e-9, 4).alias("low_conf_ratio"), F.count("*").alias("edges")
    )
    sources = m.refs.join(m.corpus.select("paper_id"), "paper_id", "left_semi").groupBy("paper_id").agg(F.count_distinct("source").alias("k"))
    return edges.crossJoin(sources.agg(F.count("*").alias("refs_with_sources"), F.count_if(F.col("k") >= 2).alias("refs_multi_source")))


@query(
    """select src, dst, etype, confidence::double as confidence from (select *, row_number() over (order by confidence, src, dst) as rn from citation_edges where confidence < 0.5) where rn <= 15""", "citation_edges"
)
def low_confidence_edges(m: Model) -> DataFrame:
    """AGG-24: a top-15 report"""
    return m.citation_edges.where("confidence < 0.5").orderBy("confidence", "src", "dst").limit(15).select("src", "dst", "etype", "confidence")


@query("select distinct o_custkey as key from orders where o_orderpriority = '1-URGENT' except select o_custkey from orders where o_orderpriority = '5-LOW'")
def known_difference(m: Model) -> DataFrame:
    """SET-03"""
    orders = m.table("orders")
    key = F.col("o_custkey").alias("key")
    return orders.where("o_orderpriority = '1-URGENT'").select(key).subtract(orders.where("o_orderpriority = '5-LOW'").select(key))


@query("select user_id, string_agg(event_type, ',' order by event_id) as kinds from (select user_id, event_type, min(event_id) as event_id from events group by all) group by user_id")
def ordered_distinct(m: Model) -> DataFrame:
    """SET-04: distinct values in order of first appearance"""
    firsts = m.table("events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("event_id", "event_type"))), lambda s: s["event_type"])
    return firsts.groupBy("user_id").agg(F.array_join(listed, ",").alias("kinds"))


@query(
    """select key, min(ordinal) as first, count(*) as copies, count(distinct source) as sources, cast(any_value(cites) as bigint) as cites from (
      select *, first_value(cited_by_count ignore nulls) over (partition by key order by ordinal rows between unbounded preceding and unbounded following) as cites from (
        select *, case when doi <> '' then doi when arxiv_id <> '' then arxiv_id else lower(trim(title)) end as key from papers)) group by key""",
    "papers",
)
def cross_source_dedupe(m: Model) -> DataFrame:
    """JON-02: one row a work, its copies' evidence merged, in order of arrival"""
    key = F.when(F.col("doi") != "", F.col("doi")).when(F.col("arxiv_id") != "", F.col("arxiv_id")).otherwise(F.lower(F.trim("title")))
    df = m.papers.withColumn("key", key)
    return df.groupBy("key").agg(
        F.min("ordinal").alias("first"), F.count("*").alias("copies"), F.count_distinct("source").alias("sources"),
        F.min_by("cited_by_count", F.when(F.col("cited_by_count").isNotNull(), F.col("ordinal"))).cast("long").alias("cites"),
    )


@query(
    """select p.paper_id, coalesce(i.paper_id, d.paper_id, t.paper_id) as resolved from papers p
      left join corpus i on i.paper_id = p.paper_id
      left join (select doi, min_by(paper_id, ordinal) as paper_id from corpus where doi <> '' group by doi) d on d.doi = lower(p.doi)
      left join (select regexp_replace(lower(title), '[^a-z0-9]+', '', 'g') as k, min_by(paper_id, ordinal) as paper_id from corpus group by 1) t on t.k = regexp_replace(lower(p.title), '[^a-z0-9]+', '', 'g') and t.k <> ''""",
    "papers", "corpus",
)
def resolved_identity(m: Model) -> DataFrame:
    """GRF-13: a paper's place in the corpus by id, then DOI, then title"""
    key = F.regexp_replace(F.lower("title"), "[^a-z0-9]+", "")
    by_doi = m.corpus.where("doi <> ''").groupBy(F.lower("doi").alias("d")).agg(F.min_by("paper_id", "ordinal").alias("by_doi"))
    by_title = m.corpus.select(key.alias("k"), "paper_id", "ordinal").where("k <> ''").groupBy("k").agg(F.min_by("paper_id", "ordinal").alias("by_title"))
    df = m.papers.select("paper_id", F.lower("doi").alias("d"), key.alias("k")).join(m.corpus.select("paper_id", F.col("paper_id").alias("by_id")), "paper_id", "left")
    return df.join(by_doi, "d", "left").join(by_title, "k", "left").select("paper_id", F.coalesce("by_id", "by_doi", "by_title").alias("resolved"))


@query(
    """select paper_id, case when s2_id <> '' then 's2_' || s2_id when doi <> '' then 'doi_' || substr(sha1(lower(doi)), 1, 10) when arxiv_id <> '' then 'arxiv_' || replace(arxiv_id, '/', '_') else 'title_' || substr(sha1(lower(title)), 1, 10) end as stable_id from papers""",
    "papers",
)
def stable_ids(m: Model) -> DataFrame:
    """GRF-14"""
    short = lambda c: F.substring(F.sha1(F.encode(F.lower(c), "UTF-8")), 1, 10)
    made = (
        F.when(F.col("s2_id") != "", F.concat(F.lit("s2_"), "s2_id"))
        .when(F.col("doi") != "", F.concat(F.lit("doi_"), short(F.col("doi"))))
        .when(F.col("arxiv_id") != "", F.concat(F.lit("arxiv_"), F.replace("arxiv_id", F.lit("/"), F.lit("_"))))
        .otherwise(F.concat(F.lit("title_"), short(F.col("title"))))
    )
    return m.papers.select("paper_id", made.alias("stable_id"))


@query(
    """select paper_id from (select *, row_number() over (partition by lower(trim(title)) order by ordinal) as rn from candidates
      where paper_id not in (select paper_id from corpus) and lower(trim(title)) not in (select lower(trim(title)) from corpus)) where rn = 1""",
    "candidates", "corpus",
)
def added_papers(m: Model) -> DataFrame:
    """GRF-12, JON-19: papers that enter the corpus, first by arrival among equal titles"""
    from quillgraph.operators.scoring import unseen

    w = Window.partitionBy(F.lower(F.trim("title"))).orderBy("ordinal")
    return unseen(m.candidates, m.corpus).withColumn("rn", F.row_number().over(w)).where("rn = 1").select("paper_id")
