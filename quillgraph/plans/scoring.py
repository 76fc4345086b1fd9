"""Queries over the scoring signals, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import signals as S
from quillgraph.functions.vectors import dot
from quillgraph.operators import graph as G
from quillgraph.operators import ranking as R
from quillgraph.operators import scoring as Q
from quillgraph.plans.model import AS_OF, AS_OF_YEAR, CTES, Model
from quillgraph.plans.registration import r6, registrar

QUERIES, ORACLES, query = registrar()

#: The given vectors are not clustered and scores are low: the queries' floors, and what still counts as few liked papers.
FLOOR, EXPLORE, GAP_FEW = 0.15, 0.12, 5

CTES["ppr_mass"] = (
    f"""ppr_pairs as (select least(src, dst) as a, greatest(src, dst) as b, max(weight) as w from (select src, dst, weight from semantic_edges union all select src, dst, weight from citation_edges) where src <> dst group by all),
ppr_arcs as (select a as src, b as dst, w from ppr_pairs union all select b, a, w from ppr_pairs),
ppr_outs as (select src, sum(w) as t from ppr_arcs group by src),
ppr_restart as (select paper_id as id, weight / sum(weight) over () as p from corpus where weight > 0),
ppr_base as (select paper_id as id, coalesce(p, 0) as p, t is null as dangling, count(*) over () as n from corpus left join ppr_restart on id = paper_id left join ppr_outs on src = paper_id),
ppr_walk as (
  select id, 1.0::double / n as r, 0 as it from ppr_base
  union all
  select b.id, 0.85 * (coalesce(f.flow, 0) + l.lost * b.p) + 0.15 * b.p, l.it + 1
  from ppr_base b
    cross join (select coalesce(sum(case when dangling then r end), 0) as lost, max(it) as it from ppr_walk join ppr_base using (id)) l
    left join (select dst, sum(r * w / t) as flow from ppr_walk w0 join ppr_arcs a on a.src = w0.id join ppr_outs o on o.src = a.src group by dst) f on f.dst = b.id
  where l.it < {R.PPR_ROUNDS}),
ppr_net as (select id, greatest(0, (r - 0.15 * coalesce(p, 0)) / 0.85) as net from ppr_walk left join ppr_restart using (id) where it = {R.PPR_ROUNDS}),
ppr_mass as (select id, net / max(net) over () as mass from ppr_net)""",
    ("semantic_edges", "citation_edges", "corpus"),
)
CTES["sig_context"] = ("sig_context as (select paper_id, list_inner_product(embedding, context) as context from candidates, context)", ("candidates", "context"))
CTES["sig_cluster"] = (
    "sig_cluster as (select paper_id, coalesce(max(s) filter (level = 1), 0) as niche, coalesce(max(s) filter (level >= 2), 0) as area from (select paper_id, level, list_inner_product(embedding, centroid) as s from candidates, clusters where clusters.weight > 0) group by paper_id)",
    ("candidates", "clusters"),
)
CTES["sig_citation"] = (
    """ref_lists as (select distinct paper_id, ref_id from refs),
ref_sizes as (select paper_id, count(*) as n, any_value(case when n_sources >= 3 then 1.0 when n_sources = 2 then 0.8 else 0.55 end) as support from ref_lists join source_counts using (paper_id) group by paper_id),
sig_citation as (
  select paper_id, coalesce(citation, 0) as citation from candidates left join (
    select c as paper_id, avg(k / sqrt(nc.n * nm.n) * w.weight / 10 * least(nc.support, nm.support)) as citation from (
      select a.paper_id as c, b.paper_id as m, count(*) as k from ref_lists a join ref_lists b using (ref_id)
      where a.paper_id in (select paper_id from candidates) and b.paper_id in (select paper_id from corpus where weight > 0) group by all
    ) join ref_sizes nc on nc.paper_id = c join ref_sizes nm on nm.paper_id = m join corpus w on w.paper_id = m group by c) using (paper_id))""",
    ("candidates", "corpus", "refs", "source_counts"),
)
CTES["sig_snf"] = (
    "sig_snf as (select c.paper_id, avg(list_inner_product(c.embedding, f.embedding)) as snf from candidates c, (select embedding from corpus where weight >= 6 order by ordinal limit 10) f group by c.paper_id)",
    ("candidates", "corpus"),
)
_DECAY = f"case when rated_at <= 0 then 1.0 else greatest(0.25, pow(2.0, -({AS_OF} - rated_at) / 86400.0 / 90.0)) end"
CTES["sig_sections"] = (
    f"""section_contexts as (
  select section_type, list_transform(x, lambda v: v / sqrt(list_inner_product(x, x))) as pooled from (select section_type, list(x order by i) as x from (
    select section_type, i, sum(w * x) / sum(w) as x from (select section_type, user_rating * {_DECAY} as w, unnest(vector) as x, generate_subscripts(vector, 1) as i from sections where role = 'corpus' and user_rating >= 5) group by all) group by all)),
sig_sections as (select paper_id, max(s) filter (section_type = 'methods') as methods, max(s) filter (section_type = 'results') as results, max(s) filter (section_type = 'discussion') as discussion, cast(null as double) as introduction
  from (select paper_id, section_type, list_inner_product(vector, pooled) as s from sections join section_contexts using (section_type) where role = 'candidate') group by paper_id)""",
    ("sections",),
)
CTES["sig_equation"] = (
    f"""equation_context as (
  select list_transform(x, lambda v: v / sqrt(list_inner_product(x, x))) as pooled from (select list(x order by i) as x from (
    select i, sum(w * x) / sum(w) as x from (select user_rating * {_DECAY} as w, unnest(vector) as x, generate_subscripts(vector, 1) as i from equations where user_rating >= 5) group by i))),
sig_equation as (select paper_id, list_inner_product(vector, pooled) as equation from equations, equation_context where role = 'candidate')""",
    ("equations",),
)
CTES["sig_ppr"] = (
    """sig_ppr as (select paper_id, coalesce(ppr, 0) as ppr from candidates left join (
  select paper_id, sum(s * mass) / sum(s) as ppr from (
    select c.paper_id, mass, list_inner_product(c.embedding, p.embedding) as s, row_number() over (partition by c.paper_id order by list_inner_product(c.embedding, p.embedding) desc, p.paper_id) as rn
    from candidates c, corpus p join ppr_mass on id = p.paper_id where list_inner_product(c.embedding, p.embedding) > 0) where rn <= 10 group by paper_id) using (paper_id))""",
    ("candidates", "corpus", "ppr_mass"),
)
_QUALITY = "case when is_peer_reviewed then 1.0 when not is_peer_reviewed then 0.3 else 0.5 end"
_RECENCY = f"case when year is null then 0.0 else greatest(0, 1 - greatest(0, {AS_OF_YEAR} - year) / 20.0) end"
_IMPACT = f"case when cited_by_count is not null then least(1.0, ln(1 + greatest(0.0, cited_by_count) / greatest(0.5, {AS_OF_YEAR} - coalesce(year, {AS_OF_YEAR}))) / ln(51)) end"
CTES["signals"] = (
    f"""signals as (
  select paper_id, [context, sig_cluster.niche, sig_cluster.area, citation, snf, {_QUALITY}, {_RECENCY}, coalesce(methods, 0), coalesce(results, 0), coalesce(discussion, 0), coalesce(introduction, 0), ppr, coalesce({_IMPACT}, 0), coalesce(equation, 0)]::double[] as signals,
    [1, 1, 1, 1, 1, 1, 1, case when methods is null then 0 else 1 end, case when results is null then 0 else 1 end, case when discussion is null then 0 else 1 end, case when introduction is null then 0 else 1 end, 1, case when cited_by_count is null then 0 else 1 end, case when equation is null then 0 else 1 end]::double[] as mask,
    {list(S.SIGNAL_WEIGHTS)}::double[] as w
  from candidates join sig_context using (paper_id) join sig_cluster using (paper_id) join sig_citation using (paper_id) join sig_snf using (paper_id) join sig_ppr using (paper_id)
    left join sig_sections using (paper_id) left join sig_equation using (paper_id)),
scored as (select paper_id, signals, mask, greatest(0, least(1, list_inner_product(signals, list_transform(list_zip(w, mask), lambda z: z[1] * z[2])) / list_inner_product(w, mask))) as score from signals)""",
    ("sig_context", "sig_cluster", "sig_citation", "sig_snf", "sig_ppr", "sig_sections", "sig_equation"),
)
CTES["novelty"] = (
    """known as (select paper_id as other, embedding as v from corpus union all select cluster_id, centroid from clusters),
novelty as (select paper_id, 1 - avg(s) as novelty from (select paper_id, list_inner_product(embedding, v) as s, row_number() over (partition by paper_id order by list_inner_product(embedding, v) desc, other) as rn from candidates, known) where rn <= 3 group by paper_id)""",
    ("candidates", "corpus", "clusters"),
)
CTES["unseen"] = ("unseen as (select * from candidates where paper_id not in (select paper_id from corpus) and trim(lower(title)) not in (select trim(lower(title)) from corpus))", ("candidates", "corpus"))
_RRF = "least(1.0, list_sum(list_transform(source_ranks, lambda r: 1.0::double / (61 + r))) / (4.0 / 61))"
CTES["relevance"] = (
    f"""relevance as (select paper_id, novelty, (case when rrf > 0 then score * 0.85 + rrf * 0.15 else score end) / case when times_shown > 0 then 1 + times_shown * 0.15 else 1 end as rel
  from (select *, {_RRF} as rrf from unseen join scored using (paper_id) join novelty using (paper_id)))""",
    ("unseen", "signals", "novelty"),
)


def mass(m: Model) -> DataFrame:
    restart = m.known.where("weight > 0").select(F.col("paper_id").alias("id"), "weight")
    return m.shared("mass", lambda: G.packed_mass(m.places, m.packed(overlay=False), restart, rounds=R.PPR_ROUNDS))


def scored(m: Model, wanted: DataFrame | None = None) -> DataFrame:
    return Q.fused(Q.signal_table(m, m.found if wanted is None else wanted, AS_OF_YEAR, AS_OF, mass(m)))


def relevance(m: Model) -> DataFrame:
    """(paper_id, rel, novelty, ...) of the unseen candidates."""
    fresh = Q.unseen(m.candidates, m.corpus)
    joined = fresh.join(scored(m, fresh).select("paper_id", "score"), "paper_id").join(Q.novelty(fresh, m.corpus, m.clusters), "paper_id")
    return joined.withColumn("rel", S.blended(F.col("score"), S.reciprocal_rank_fusion(F.col("source_ranks")), F.col("times_shown")))


@query(f"select paper_id, round({_DECAY}, 6) as decay, round(weight, 6) as weight, (case when filepath <> '' then 1.0 when source = 'scout' then 0.7 else 1.0 end)::double as evidence from papers", "papers")
def sig_weights(m: Model) -> DataFrame:
    """SIG-02, SIG-03, SIG-04"""
    return m.papers.select("paper_id", r6(S.temporal_decay(F.col("rated_at"), AS_OF), "decay"), r6(F.col("weight"), "weight"), S.evidence_factor(F.col("source"), F.col("filepath") != "").alias("evidence"))


@query(f"select paper_id, is_peer_reviewed, cast({_QUALITY} as double) as quality from papers", "papers")
def sig_peer_review(m: Model) -> DataFrame:
    """SIG-05, SIG-06"""
    return m.papers.select("paper_id", "is_peer_reviewed", S.publication_quality(F.col("is_peer_reviewed")).alias("quality"))


@query(f"select paper_id, round(cast({_RECENCY} as double), 6) as recency, round({_IMPACT}, 6) as impact from papers", "papers")
def sig_recency_impact(m: Model) -> DataFrame:
    """SIG-07, SIG-08"""
    return m.papers.select("paper_id", r6(S.recency(F.col("year"), AS_OF_YEAR), "recency"), r6(S.impact(F.col("cited_by_count"), F.col("year"), AS_OF_YEAR), "impact"))


@query(f"select paper_id, round({_RRF}, 6) as rrf from papers", "papers")
def sig_rank_fusion(m: Model) -> DataFrame:
    """SIG-09"""
    return m.papers.select("paper_id", r6(S.reciprocal_rank_fusion(F.col("source_ranks")), "rrf"))


@query("select event_id, case when try_cast(substr(trim(substr(props, 7)), 1, 4) as integer) between 1000 and 2100 then try_cast(substr(trim(substr(props, 7)), 1, 4) as integer) end as year from events")
def sig_coerced_year(m: Model) -> DataFrame:
    """SIG-01"""
    return m.table("events").select("event_id", S.coerced_year(F.substring("props", 7, 99)).alias("year"))


@query("select paper_id, round((case when doi <> '' then 0.25 else 0 end) + (case when s2_id <> '' then 0.2 else 0 end) + (case when year between 1900 and 2030 then 0.15 else 0 end) + (case when length(abstract) > 50 then 0.2 else 0 end) + (case when len(authors) > 0 then 0.1 else 0 end) + (case when length(title) > 10 then 0.1 else 0 end)::double, 6) as quality from papers", "papers")
def sig_metadata_quality(m: Model) -> DataFrame:
    """SIG-29"""
    return m.papers.select("paper_id", r6(S.metadata_quality(F.col("doi"), F.col("s2_id"), F.col("year"), F.col("abstract"), F.size("authors"), F.col("title")), "quality"))


@query("select paper_id, case when user_rating is null then 'skipped' when user_rating >= 6 then 'included' else 'excluded' end as decision from papers", "papers")
def sig_screen_decision(m: Model) -> DataFrame:
    """SIG-32"""
    return m.papers.select("paper_id", S.screen_decision(F.col("user_rating")).alias("decision"))


@query("select event_id, (event_type <> 'click' and epoch(timestamp '2024-02-01') - epoch(ts) >= greatest(1.0, value) * 3600) as due from events")
def sig_due(m: Model) -> DataFrame:
    """SIG-33"""
    return m.table("events").select("event_id", S.is_due(F.col("event_type") != "click", F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts")) / 1e6, F.col("value"), AS_OF).alias("due"))


@query("select paper_id, round(context, 6) as context from sig_context", "sig_context")
def sig_context(m: Model) -> DataFrame:
    """SIG-10, SIG-11, SIG-12, AGG-01"""
    return Q.context_similarity(m.candidates, m.context).select("paper_id", r6(F.col("context"), "context"))


@query("select level, cluster_id, size, round(weight, 6) as weight, cast(high as bigint) as high, round(centroid[1], 6) as first from clusters", "clusters")
def cluster_centroids(m: Model) -> DataFrame:
    """AGG-04"""
    return m.clusters.select("level", "cluster_id", "size", r6(F.col("weight"), "weight"), "high", r6(F.element_at("centroid", 1), "first"))


@query("select paper_id, round(niche, 6) as niche, round(area, 6) as area from sig_cluster", "sig_cluster")
def sig_clusters(m: Model) -> DataFrame:
    """SIG-13, SIG-14"""
    return Q.cluster_similarity(m.candidates, m.clusters).select("paper_id", r6(F.col("niche"), "niche"), r6(F.col("area"), "area"))


@query("select paper_id, round(citation, 6) as citation from sig_citation", "sig_citation")
def sig_citation(m: Model) -> DataFrame:
    """SIG-15"""
    return Q.citation_signal(m.found, m.known, m.refs).select("paper_id", r6(F.col("citation"), "citation"))


@query("select paper_id, round(snf, 6) as snf from sig_snf", "sig_snf")
def sig_favourites(m: Model) -> DataFrame:
    """SIG-16"""
    return Q.favourites_similarity(m.candidates, m.corpus).select("paper_id", r6(F.col("snf"), "snf"))


@query("select paper_id, round(methods, 6) as methods, round(results, 6) as results, round(discussion, 6) as discussion, introduction from sig_sections", "sig_sections")
def sig_sections(m: Model) -> DataFrame:
    """SIG-17, AGG-03"""
    contexts = Q.section_contexts(m.sections.where("role = 'corpus'"), AS_OF)
    return Q.section_signals(m.sections.where("role = 'candidate'"), contexts).select("paper_id", *[r6(F.col(t), t) for t in S.SECTION_TYPES])


@query("select paper_id, round(equation, 6) as equation from sig_equation", "sig_equation")
def sig_equation(m: Model) -> DataFrame:
    """SIG-18"""
    return Q.equation_signal(m.equations, m.candidates, AS_OF).select("paper_id", r6(F.col("equation"), "equation"))


@query("select id as paper_id, round(mass, 6) as mass from ppr_mass", "ppr_mass")
def network_mass(m: Model) -> DataFrame:
    """ITR-02"""
    return mass(m).select(F.col("id").alias("paper_id"), r6(F.col("mass"), "mass"))


@query("select paper_id, round(ppr, 6) as ppr from sig_ppr", "sig_ppr")
def sig_network(m: Model) -> DataFrame:
    """SIG-19"""
    return Q.network_signal(m.found, m.known, mass(m)).select("paper_id", r6(F.col("ppr"), "ppr"))


@query("select paper_id, unnest(list_transform(signals, lambda s: round(s, 6))) as value, unnest(mask) as supplied, generate_subscripts(signals, 1) - 1 as position from signals", "signals")
def signal_vectors(m: Model) -> DataFrame:
    """SIG-20, SIG-21"""
    df = Q.signal_table(m, m.candidates, AS_OF_YEAR, AS_OF, mass(m))
    return df.select("paper_id", F.posexplode(F.arrays_zip("signals", "mask"))).select("paper_id", F.col("pos").cast("long").alias("position"), r6(F.col("col.signals"), "value"), F.col("col.mask").alias("supplied"))


@query("select paper_id, round(score, 6) as score from scored", "signals")
def score_candidates(m: Model) -> DataFrame:
    """SIG-22"""
    return scored(m).select("paper_id", r6(F.col("score"), "score"))


@query(
    f"""select c.paper_id, round(greatest(0, least(1, (coalesce(top, 0) + 4 * context + case when year is null then 0 else 0.5 end * {_RECENCY} + 0.3 * {_QUALITY}) / (coalesce(total, 0) + 4 + case when year is null then 0 else 0.5 end + 0.3)))::double, 6) as score
    from candidates c join sig_context using (paper_id), (select sum(weight / 5.0) as total from corpus where weight > 0) join (
      select c.paper_id, sum(list_inner_product(c.embedding, p.embedding) * p.weight / 5.0) as top from candidates c, corpus p where p.weight > 0 group by c.paper_id) t on t.paper_id = c.paper_id""",
    "sig_context", "corpus",
)
def cold_start_score(m: Model) -> DataFrame:
    """SIG-23"""
    return Q.cold_start(m.candidates, m.corpus, m.context, AS_OF_YEAR).select("paper_id", r6(F.col("score"), "score"))


@query("select paper_id, round(novelty, 6) as novelty from novelty", "novelty")
def novelty(m: Model) -> DataFrame:
    """SIG-24"""
    return Q.novelty(m.candidates, m.corpus, m.clusters).select("paper_id", r6(F.col("novelty"), "novelty"))


@query("select paper_id, round(rel, 6) as rel, round(novelty, 6) as novelty from relevance", "relevance")
def blended_relevance(m: Model) -> DataFrame:
    """SIG-25, JON-01"""
    return relevance(m).select("paper_id", r6(F.col("rel"), "rel"), r6(F.col("novelty"), "novelty"))


@query(f"select cluster_id, size, cast(high as bigint) as high from clusters where level = 1 and ((size >= 2 and high = 0) or (size >= 4 and high <= {GAP_FEW}))", "clusters")
def coverage_gaps(m: Model) -> DataFrame:
    """SIG-26"""
    return Q.coverage_gaps(m.clusters, GAP_FEW).select("cluster_id", "size", "high")


_RATIO = """select round(case when n < 15 then least(0.4, 0.25 * 1.6) when niches <= 1 then least(0.4, 0.25 * 1.5) when k >= 2 and n_rated >= 10 then greatest(0.1, least(0.4, 0.25 * (1.5 - entropy / ln(k + 1e-10)))) else 0.25 end::double, 6) as ratio
  from (select count(*) as n, count(distinct niche) as niches from corpus), (select count(*) as k, sum(c) as n_rated, -sum(c / t * ln(c / t + 1e-10)) as entropy from (select niche, count(*) as c, sum(count(*)) over () as t from corpus where user_rating is not null group by niche))"""


@query(_RATIO, "corpus")
def exploration_ratio(m: Model) -> DataFrame:
    """SIG-27"""
    return Q.exploration_ratio(m.corpus, m.membership).select(r6(F.col("ratio"), "ratio"))


@query(
    f"""select paper_id, round(rel, 6) as rel, round(0.3 * novelty + 0.5 * affinity + 0.2 * rel, 6) as explore from relevance join (
      select paper_id, max(list_inner_product(embedding, centroid)) as affinity from candidates, clusters where level = 1 and ((size >= 2 and high = 0) or (size >= 4 and high <= {GAP_FEW})) group by paper_id) using (paper_id)
    where novelty >= 0.3 and rel >= {EXPLORE} and 0.3 * novelty + 0.5 * affinity + 0.2 * rel > 0""",
    "relevance", "clusters",
)
def explore_order(m: Model) -> DataFrame:
    """WIN-04"""
    return R.explore_scores(relevance(m), Q.coverage_gaps(m.clusters, GAP_FEW), EXPLORE).select("paper_id", r6(F.col("rel"), "rel"), r6(F.col("explore"), "explore"))


@query(
    f"""select paper_id, label, rank, round(value, 6) as value from (
      select paper_id, 'relevant' as label, row_number() over (order by round(rel, 9) desc, paper_id) as rank, rel as value from relevance where rel >= {FLOOR})
    where rank <= 10 - greatest(1, cast(floor(10 * (select ratio from ({_RATIO}))) as bigint))
    union all
    select paper_id, label, rank, round(value, 6) from (
      select paper_id, 'explore' as label, row_number() over (order by round(novelty, 9) desc, paper_id) as rank, novelty as value from relevance where rel >= {EXPLORE} and novelty >= 0.3
        and paper_id not in (select paper_id from (select paper_id, row_number() over (order by round(rel, 9) desc, paper_id) as r from relevance where rel >= {FLOOR}) where r <= 10 - greatest(1, cast(floor(10 * (select ratio from ({_RATIO}))) as bigint))))
    where rank <= greatest(1, cast(floor(10 * (select ratio from ({_RATIO}))) as bigint))""",
    "relevance",
)
def rank_candidates(m: Model) -> DataFrame:
    """WIN-01: the slate of ten, relevant and exploratory, before diversification"""
    ratio = Q.exploration_ratio(m.corpus, m.membership).select(F.round("ratio", 6).alias("ratio")).first()[0]
    return R.slate(relevance(m), 10, ratio, FLOOR, EXPLORE).select("paper_id", "label", F.col("rank").cast("long").alias("rank"), r6(F.col("value"), "value"))


@query()
def mmr_slate(m: Model) -> DataFrame:
    """WIN-02: greedy diversified slate of the relevant candidates"""
    pool = relevance(m).where(F.col("rel") >= FLOOR).select(F.col("paper_id").alias("id"), F.col("rel").alias("score"), "embedding")
    return R.diversified(pool, 10)


@query()
def reasoner_mmr(m: Model) -> DataFrame:
    """WIN-03: the best answer first, then diversity among three times as many"""
    pool = m.corpus.crossJoin(F.broadcast(m.question)).select(F.col("paper_id").alias("id"), dot("embedding", "question").alias("score"), "embedding")
    return R.diversified(pool.orderBy(F.desc("score"), "id").limit(30), 10)


@query("select paper_id, round(0.6 * context + 0.4 * citation, 6) as fused from sig_context join sig_citation using (paper_id)", "sig_context", "sig_citation")
def sig_linear_fusion(m: Model) -> DataFrame:
    """SIG-31"""
    joined = Q.context_similarity(m.candidates, m.context).join(Q.citation_signal(m.candidates, m.corpus, m.refs), "paper_id")
    return joined.select("paper_id", r6(S.linear_fusion(F.col("context"), F.col("citation")), "fused"))


@query(
    """select paper_id, round(list_inner_product(embedding, focus), 6) as focus from candidates, (select list_transform(x, lambda v: v / sqrt(list_inner_product(x, x))) as focus from (select list(x order by i) as x from (
      select i, sum(w * x) / sum(w) as x from (select greatest(weight, 1.0) as w, unnest(embedding) as x, generate_subscripts(embedding, 1) as i from corpus where niche = 'L1C3') group by i)))""",
    "candidates", "corpus",
)
def focused_context(m: Model) -> DataFrame:
    """AGG-02: candidates against the context of one niche's papers"""
    from quillgraph.functions.vectors import mean_pool

    chosen = m.corpus.where("niche = 'L1C3'").withColumn("w", F.greatest("weight", F.lit(1.0)))
    context = mean_pool(chosen, "embedding", "w").withColumnRenamed("pooled", "context")
    return Q.context_similarity(m.candidates, context).select("paper_id", r6(F.col("context"), "focus"))


@query("select paper_id, row_number() over (order by case when is_peer_reviewed is not null and not is_peer_reviewed then 1 else 0 end, lower(title), paper_id) as position from candidates", "candidates")
def candidate_order(m: Model) -> DataFrame:
    """WIN-18"""
    ranked = R.numbered(m.candidates, [F.coalesce((~F.col("is_peer_reviewed")).cast("int"), F.lit(0)), F.lower("title"), F.col("paper_id")])
    return ranked.select("paper_id", "position")


@query(
    """select paper_id, split, position from (
      select paper_id, case when (row_number() over (partition by case when user_rating >= 7 then 2 when user_rating <= 3 then 0 else 1 end order by paper_id)) % 2 = 1 then 'train' else 'validation' end as split,
        row_number() over (partition by case when user_rating >= 7 then 2 when user_rating <= 3 then 0 else 1 end order by paper_id) as position from corpus where user_rating is not null)""",
    "corpus",
)
def stratified_split(m: Model) -> DataFrame:
    """WIN-17"""
    group = F.when(F.col("user_rating") >= 7, 2).when(F.col("user_rating") <= 3, 0).otherwise(1)
    w = Window.partitionBy(group).orderBy("paper_id")
    rated = m.corpus.where("user_rating is not null").withColumn("position", F.row_number().over(w).cast("long"))
    return rated.select("paper_id", F.when(F.pmod("position", F.lit(2)) == 1, "train").otherwise("validation").alias("split"), "position")
