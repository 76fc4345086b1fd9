"""Queries with sequential or dense numerics: hierarchy, fusion, learning, graph distances, the scout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import signals as S
from quillgraph.functions.store import settled
from quillgraph.functions.vectors import dot
from quillgraph.operators import distances as D
from quillgraph.operators import fusion, hierarchy, learning
from quillgraph.operators import graph as G
from quillgraph.operators import ranking as R
from quillgraph.operators.citations import both_directions, coupling
from quillgraph.plans import scoring
from quillgraph.plans.model import AS_OF_YEAR, Model
from quillgraph.plans.registration import r6, registrar

QUERIES, ORACLES, query = registrar()


@query()
def ward_memberships(m: Model) -> DataFrame:
    """ITR-04, WIN-12: the levels that the dendrogram shows"""
    return hierarchy.memberships(m.corpus)


@query()
def hierarchy_edges(m: Model) -> DataFrame:
    """ITR-05: nodes joined to their clusters, clusters to each other"""
    return hierarchy.assembled(m.corpus, hierarchy.memberships(m.corpus))[1]


@query(
    """daily as (select date_trunc('day', ts) as step, sum(value) as v from events group by 1), merges as (select row_number() over (order by v) as step, v as distance from daily),
    facts as (select step, distance, lead(distance) over (order by step) - 2 * distance + lag(distance) over (order by step) as curve, (lead(distance) over (order by step) - distance) / (distance + 1e-10) as growth from merges),
    limits as (select avg(curve) + 0.8 * stddev_pop(curve) as cl, quantile_cont(growth, 0.75) as gl from facts)
    select step, round(distance, 4) as distance, coalesce(curve > cl, false) as curve_peak, coalesce(growth > gl, false) as growth_peak from facts, limits"""
)
def merge_peaks(m: Model) -> DataFrame:
    """WIN-12: where a rising series of merge distances jumps"""
    from pyspark.sql import Window

    daily = m.table("events").groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.sum("value").alias("distance"))
    merges = daily.withColumn("step", F.row_number().over(Window.orderBy("distance")).cast("long"))  # one row a day
    return hierarchy.peaks(merges).select("step", F.round("distance", 4).alias("distance"), "curve_peak", "growth_peak")


@query()
def network_fusion(m: Model) -> DataFrame:
    """ITR-01: cross-diffusion of the semantic network and all coupling of the corpus"""
    large = m.known.count() > fusion.PANEL_NODES  # then no table has a row a pair, nor a shuffle a copy for each two blocks
    semantic = _mirrored(m.alike(again=True).withColumnRenamed("sim", "weight")) if large else m.semantic_edges
    return fusion.fuse(semantic, _mirrored(coupling(m.own_refs, again=large)), mirrored=True)


def _mirrored(pairs: DataFrame) -> DataFrame:
    """(src, dst, weight) both ways of (a, b, weight), which are made once."""
    return pairs.select(F.explode(both_directions("a", "b")).alias("e"), "weight").select("e.*", "weight")


@query(
    """n as (select min(weight) as lo, max(weight) as hi from semantic_edges) select src, dst, round((weight - least(0, lo)) / (hi - least(0, lo)), 6) as weight from semantic_edges, n""", "semantic_edges"
)
def scaled_network(m: Model) -> DataFrame:
    """ITR-01: min-max scaling, and what stays where citations are too sparse"""
    return fusion.scaled(m.semantic_edges).select("src", "dst", r6("weight"))


def _signals(m: Model) -> DataFrame:
    from quillgraph.operators.scoring import signal_table
    from quillgraph.plans.model import AS_OF

    return settled(signal_table(m, m.corpus, AS_OF_YEAR, AS_OF, scoring.mass(m)), "signals")


@query()
def learned_weights(m: Model) -> DataFrame:
    """ITR-09, ITR-10: weights of the fourteen signals, and the ensemble's mean and spread"""
    weights, members = learning.learned(_signals(m), m.corpus)
    if weights is None:
        return m.spark.createDataFrame([], "signal string, weight double, mean double, spread double")
    rows = [(n, float(w), float(members[:, i].mean()) if members is not None else None, float(members[:, i].std()) if members is not None else None) for i, (n, w) in enumerate(zip(S.SIGNALS, weights, strict=True))]
    return m.spark.createDataFrame(rows, "signal string, weight double, mean double, spread double")


@query()
def rating_queue(m: Model) -> DataFrame:
    """WIN-06: the ten unrated papers most worth a rating"""
    signals = _signals(m)
    weights, members = learning.learned(signals, m.corpus)
    unrated = signals.join(m.corpus.where("user_rating is null and kind = 'paper'").select("paper_id"), "paper_id", "left_semi")
    scored = learning.uncertainty(unrated, S.SIGNAL_WEIGHTS if weights is None else weights, members)
    return scored.orderBy(F.desc("acquisition"), "paper_id").limit(10)


@query()
def tuned_parameters(m: Model) -> DataFrame:
    """ITR-13: a short session on the recency and quality weights of rated papers, logged round by round"""
    import numpy as np

    x, _, r = learning.rated_matrix(_signals(m), m.corpus)

    def auc(scores, part):
        s, rated = scores[part], r[part]
        return learning.auc(s[rated >= 7], s[rated <= 3])

    def evaluate(p):
        w = np.array(S.SIGNAL_WEIGHTS)
        w[5], w[6] = p["quality"], p["recency"]
        s = x @ w / w.sum()
        return auc(s, slice(0, None, 2)), auc(s, slice(1, None, 2))

    _, log = learning.tune(evaluate, {"quality": (0.0, 2.0, 0.5), "recency": (0.0, 2.0, 0.5)}, {"quality": 0.5, "recency": 0.3}, rounds=12)
    return m.spark.createDataFrame([(e["round"], e["parameter"], e["value"], e["train"], e["validation"], bool(e["kept"])) for e in log], "round int, parameter string, value double, train double, validation double, kept boolean")


@query(
    """shown as (select paper_id, embedding, user_rating, row_number() over (order by round(list_inner_product(embedding, question), 9) desc, paper_id) as rank from corpus, question qualify rank <= 10),
    pairs as (select a.paper_id as src, b.paper_id as dst, list_inner_product(a.embedding, b.embedding) as sim from shown a join shown b on a.rank < b.rank)
    select coalesce(e.src, p.src) as src, coalesce(e.dst, p.dst) as dst, round(case when e.weight is not null and sim is not null then least(1.0, e.weight + 0.1) when e.weight is not null then e.weight else sim end, 6) as weight, case when e.weight is not null then 'semantic' else 'interest' end as etype
    from semantic_edges e full join pairs p on p.src = e.src and p.dst = e.dst where e.weight is not null or sim > 0.1""",
    "corpus", "question", "semantic_edges",
)
def query_feedback(m: Model) -> DataFrame:
    """ITR-11: the edges after the answers to a query were rated 8"""
    shown = R.top(m.corpus.crossJoin(F.broadcast(m.question)).select("paper_id", F.round(dot("embedding", "question"), 9).alias("s")), [F.desc("s"), F.col("paper_id")], 10)
    edges, _ = learning.feedback(m.semantic_edges.withColumn("etype", F.lit("semantic")), m.corpus, settled(shown, "shown"), 8, least=0.1)
    return edges.select("src", "dst", r6("weight"), "etype")


@query(
    """shown as (select paper_id, row_number() over (order by round(list_inner_product(embedding, question), 9) desc, paper_id) as rank from corpus, question qualify rank <= 10)
    select c.paper_id, round(case when s.rank <= 5 then greatest(1.0, c.weight - 0.4) else c.weight end, 6) as weight from corpus c left join shown s using (paper_id)""",
    "corpus", "question",
)
def dampened_weights(m: Model) -> DataFrame:
    """ITR-11: node weights after the answers to a query were rated 2"""
    shown = R.top(m.corpus.crossJoin(F.broadcast(m.question)).select("paper_id", F.round(dot("embedding", "question"), 9).alias("s")), [F.desc("s"), F.col("paper_id")], 10)
    _, weights = learning.feedback(m.semantic_edges, m.corpus, settled(shown, "shown"), 2)
    return weights.select("paper_id", r6("weight"))


@query()
def graph_distances(m: Model) -> DataFrame:
    """AGG-25, AGG-26, AGG-27, AGG-29, AGG-30: the semantic graph against the citation graph over the corpus"""
    import numpy as np

    ids = sorted(r.paper_id for r in m.known.select("paper_id").limit(D.MAX_NODES + 1).collect())  # one more: ``compared`` refuses them
    found = D.compared(*(G.undirected(e.select("src", "dst", "weight")) for e in (m.semantic_edges, m.direct_edges)), ids)
    centroids = {level: np.array([r.centroid for r in m.clusters.where(F.col("level") == level).orderBy("cluster_id").collect()]) for level in (1, 2)}
    gw = D.gromov_wasserstein(*(D.embedding_costs(c) for c in centroids.values()))
    return m.spark.createDataFrame([(*found, gw)], "spectral double, deltacon double, degree_ks double, modularity double, communities int, gromov_wasserstein double")


def _scout(m: Model) -> DataFrame:
    """(paper_id, prior, ppr, impact, keep, user_rating, embedding, ...) of the corpus seen as a scout's graph."""
    prior = F.greatest(F.lit(0.0), dot("embedding", "context"))
    papers = m.corpus.crossJoin(F.broadcast(m.context)).withColumn("prior", prior).drop("context")
    papers = settled(papers.select("paper_id", "title", "user_rating", "cited_by_count", "year", "embedding", "prior"), "scout")
    anchored = F.when(F.col("user_rating") >= 9, F.greatest("prior", F.lit(0.5)) * 3).otherwise(F.col("prior"))
    restart = papers.select(F.col("paper_id").alias("id"), anchored.alias("w")).where("w > 0")
    total = restart.agg(F.sum("w")).first()[0]
    shares = settled(restart.select("id", (F.col("w") / F.lit(total)).alias("share")), "restart")
    ranks = settled(G.pagerank(papers.select(F.col("paper_id").alias("id")), m.semantic_edges, shares, rounds=R.PPR_ROUNDS), "scout-ranks")
    peak = ranks.agg(F.max("rank")).first()[0]
    joined = papers.join(ranks.select(F.col("id").alias("paper_id"), (F.col("rank") / F.lit(peak)).alias("ppr")), "paper_id")
    return joined.withColumn("impact", F.coalesce(S.impact(F.col("cited_by_count"), F.col("year"), AS_OF_YEAR), F.lit(0.0))).withColumn("keep", 0.6 * F.col("prior") + 0.4 * F.col("ppr"))


_SCOUT = f"""prior as (select paper_id, user_rating, greatest(0, list_inner_product(embedding, context)) as prior from corpus, context),
    restart as (select paper_id as id, w / sum(w) over () as p from (select paper_id, case when user_rating >= 9 then greatest(prior, 0.5) * 3 else prior end as w from prior) where w > 0),
    outs as (select src, sum(weight) as t from semantic_edges group by src),
    base as (select paper_id as id, coalesce(p, 0) as p, t is null as dangling, count(*) over () as n from corpus left join restart on id = paper_id left join outs on src = paper_id),
    walk as (select id, 1.0::double / n as r, 0 as it from base union all
      select b.id, 0.85 * (coalesce(f.flow, 0) + l.lost * b.p) + 0.15 * b.p, l.it + 1 from base b
        cross join (select coalesce(sum(case when dangling then r end), 0) as lost, max(it) as it from walk join base using (id)) l
        left join (select dst, sum(r * weight / t) as flow from walk w0 join semantic_edges a on a.src = w0.id join outs o on o.src = a.src group by dst) f on f.dst = b.id where l.it < {R.PPR_ROUNDS}),
    scout as (select p.*, r / max(r) over () as ppr, 0.6 * prior + 0.4 * (r / max(r) over ()) as keep from walk join prior p on p.paper_id = id where it = {R.PPR_ROUNDS})"""


@query(_SCOUT + " select paper_id, round(prior, 6) as prior, round(ppr, 6) as ppr from scout", "corpus", "context", "semantic_edges")
def scout_ranks(m: Model) -> DataFrame:
    """ITR-03"""
    return _scout(m).select("paper_id", r6("prior"), r6("ppr"))


@query(
    _SCOUT + """ select paper_id, user_rating is not null as protected from (select *, row_number() over (partition by user_rating is not null order by round(keep, 9) desc, paper_id) as rn from scout)
    where user_rating is not null or rn <= greatest(0, 300 - (select count(*) from scout where user_rating is not null))""",
    "corpus", "context", "semantic_edges",
)
def scout_prune(m: Model) -> DataFrame:
    """WIN-14: rated papers and the best others, 300 in all"""
    papers = settled(_scout(m).select("paper_id", "user_rating", "keep"), "kept")
    rated = papers.where("user_rating is not null")
    rest = papers.where("user_rating is null").orderBy(F.desc(F.round("keep", 9)), "paper_id").limit(max(0, 300 - rated.count()))
    return rated.unionByName(rest).select("paper_id", F.col("user_rating").isNotNull().alias("protected"))


@query()
def scout_slate(m: Model) -> DataFrame:
    """WIN-15, ITR-14: the twelve finds of a scout cycle"""
    s = 0.5 * F.col("prior") + 0.3 * F.col("ppr") + 0.2 * F.col("impact")
    return R.scout_slate(_scout(m).where("user_rating is null").select(F.col("paper_id").alias("id"), s.alias("score"), "embedding"))
