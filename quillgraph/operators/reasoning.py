"""Answers to a text query over the corpus graph: ranked papers, niche profiles, connections, bridges, frontier, lineages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.store import small
from quillgraph.functions.text import keyword_score
from quillgraph.functions.vectors import dot
from quillgraph.operators import graph as G
from quillgraph.operators.ranking import top

TOP = 10


def retrieved(papers: DataFrame, question: DataFrame, query: str, edges: DataFrame | None, ranks: DataFrame) -> DataFrame:
    """(paper_id, blended, sim, keyword, centrality, degree, role) of every paper; without edges the ranks have the degrees.

    Centrality weighs the more, the sparser the graph; the rest is split between similarity and keywords. Hubs are the
    papers whose degree reaches that of the fifth of all papers with the highest.
    """
    degree = ranks.select("id", "degree") if edges is None else G.settled(G.degrees(edges, papers.select(F.col("paper_id").alias("id"))), "degrees")
    n, ends = degree.agg(F.count("*"), F.sum("degree")).first()
    density = (ends / n) / max(n - 1, 1)
    weight = max(0.02, 0.15 * (1 - density))
    place = max(0, n // 5 - 1)
    hub = degree.orderBy(F.desc("degree")).limit(place + 1).agg(F.min("degree")).first()[0]
    peak = ranks.agg(F.max("rank")).first()[0] or 1e-9
    df = papers.crossJoin(F.broadcast(question)).select("paper_id", dot("embedding", "question").alias("sim"), keyword_score(query, F.col("title"), F.col("abstract")).alias("keyword"))
    df = df.join(degree.withColumnRenamed("id", "paper_id"), "paper_id").join(ranks.select(F.col("id").alias("paper_id"), (F.col("rank") / F.lit(peak)).alias("centrality")), "paper_id", "left")
    df = df.withColumn("centrality", F.coalesce("centrality", F.lit(0.0)))
    rest = 1 - weight
    role = F.when(F.col("degree") >= hub, "hub").when(F.col("degree") == 0, "isolated").otherwise("connected")
    return df.withColumn("blended", rest * 0.55 * F.col("sim") + rest * 0.45 * F.col("keyword") + weight * F.col("centrality")).withColumn("role", role)


def answers(found: DataFrame, k: int = TOP) -> DataFrame:
    return top(found.withColumn("_s", F.round("blended", 9)), [F.desc("_s"), F.col("paper_id")], k).drop("_s")


def niche_profiles(clusters: DataFrame, members: DataFrame, papers: DataFrame, question: DataFrame, edges: DataFrame, floor: float = 0.30, k: int = 4) -> DataFrame:
    """The k niches most like the query: size, inner density, mean year, best connected paper, maturity."""
    near = clusters.where("level = 1").crossJoin(F.broadcast(question)).select("cluster_id", "size", dot("centroid", "question").alias("similarity")).where(F.col("similarity") >= floor)
    near = near.orderBy(F.desc(F.round("similarity", 9)), "cluster_id").limit(k)
    inside = members.where("level = 1").select("paper_id", "cluster_id").join(F.broadcast(near.select("cluster_id")), "cluster_id", "left_semi")
    ends = edges.join(inside.select(F.col("paper_id").alias("src"), F.col("cluster_id").alias("a")), "src").join(inside.select(F.col("paper_id").alias("dst"), F.col("cluster_id").alias("b")), "dst")
    inner = ends.where("a = b and src <> dst").groupBy(F.col("a").alias("cluster_id")).agg(F.count("*").alias("links"))
    degree = G.degrees(edges).withColumnRenamed("id", "paper_id")
    facts = inside.join(papers.select("paper_id", "year", "ordinal"), "paper_id").join(degree, "paper_id", "left")
    facts = facts.groupBy("cluster_id").agg(F.avg("year").alias("mean_year"), F.max_by("paper_id", F.struct(F.coalesce("degree", F.lit(0)), -F.col("ordinal"))).alias("central"))
    y = F.col("mean_year")
    maturity = F.when(y.isNull(), "unknown").when(y >= 2020, "emerging").when(y >= 2010, "growing").otherwise("established")
    density = F.when(F.col("size") >= 2, F.coalesce("links", F.lit(0)) / (F.col("size") * (F.col("size") - 1))).otherwise(0.0)
    return near.join(facts, "cluster_id").join(inner, "cluster_id", "left").select("cluster_id", "size", "similarity", density.alias("density"), "mean_year", "central", maturity.alias("maturity"))


def connections(shown: DataFrame, citations: DataFrame, semantic: DataFrame, refs: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b, kind, detail) among the shown papers (a ranked before b): edges, shared references, same niche."""
    ids = shown.select("paper_id", "rank")
    pairs = ids.select(F.col("paper_id").alias("a"), F.col("rank").alias("ra")).crossJoin(F.broadcast(ids.select(F.col("paper_id").alias("b"), F.col("rank").alias("rb")))).where("ra < rb").select("a", "b")
    either = lambda e, name: G.undirected(e.select("src", "dst", F.lit(1.0).alias("weight"))).select(F.col("a").alias("x"), F.col("b").alias("y"), F.lit(True).alias(name))
    keyed = pairs.withColumn("x", F.least("a", "b")).withColumn("y", F.greatest("a", "b"))
    joined = keyed.join(either(citations, "cited"), ["x", "y"], "left").join(either(semantic, "alike"), ["x", "y"], "left")
    edge = F.when(F.col("cited") & F.col("alike"), "citation + semantic similarity").when(F.col("cited"), "citation").when(F.col("alike"), "semantic similarity")
    links = joined.select("a", "b", F.lit("edge").alias("kind"), edge.alias("detail")).where("detail is not null")
    own = refs.join(F.broadcast(ids.select("paper_id")), "paper_id", "left_semi").select("paper_id", "ref_id").distinct()
    shared = pairs.join(own.select(F.col("paper_id").alias("a"), "ref_id"), "a").join(own.select(F.col("paper_id").alias("b"), "ref_id"), ["b", "ref_id"]).groupBy("a", "b").agg(F.count("*").alias("n"))
    coupled = shared.select("a", "b", F.lit("references").alias("kind"), F.concat(F.lit("share "), F.col("n").cast("string"), F.lit(" reference(s)")).alias("detail"))
    niche = members.where("level = 1").select("paper_id", "cluster_id")
    same = pairs.join(niche.select(F.col("paper_id").alias("a"), "cluster_id"), "a").join(niche.select(F.col("paper_id").alias("b"), "cluster_id"), ["b", "cluster_id"])
    return links.unionByName(coupled).unionByName(same.select("a", "b", F.lit("niche").alias("kind"), F.concat(F.lit("same niche ("), "cluster_id", F.lit(")")).alias("detail")))


def bridges(papers: DataFrame, niches: DataFrame, shown: DataFrame, floor: float = 0.40, k: int = 3) -> DataFrame:
    """The k papers, not shown, whose least similarity to the matched niches is highest. ``niches``: few rows with centroid."""
    sims = papers.select("paper_id", "embedding").crossJoin(small(niches.select("centroid"), 16)).groupBy("paper_id").agg(F.min(dot("embedding", "centroid")).alias("least"))
    fresh = sims.where(F.col("least") > floor).join(F.broadcast(shown.select("paper_id")), "paper_id", "left_anti")
    return fresh.orderBy(F.desc(F.round("least", 9)), "paper_id").limit(k)


def frontier(papers: DataFrame, question: DataFrame, shown: DataFrame, edges: DataFrame, floor: float = 0.40, most: int = 2, k: int = 3) -> DataFrame:
    """The k papers most like the query that are not shown and hardly connected."""
    degree = G.degrees(edges).withColumnRenamed("id", "paper_id")
    near = papers.crossJoin(F.broadcast(question)).select("paper_id", dot("embedding", "question").alias("sim")).where(F.col("sim") >= floor)
    loose = near.join(F.broadcast(shown.select("paper_id")), "paper_id", "left_anti").join(degree, "paper_id", "left").where(F.coalesce("degree", F.lit(0)) <= most)
    return loose.orderBy(F.desc(F.round("sim", 9)), "paper_id").limit(k).select("paper_id", "sim")


def narrative(shown: DataFrame) -> DataFrame:
    """One row: span, oldest and newest title, and the decade that holds over half of the dated papers, if any."""
    dated = shown.where("year is not null")
    span = dated.agg(F.min_by("title", F.struct("year", "rank")).alias("oldest"), F.max_by("title", F.struct("year", "rank")).alias("newest"), F.min("year").alias("first"), F.max("year").alias("last"), F.count("*").alias("n"))
    decades = dated.groupBy((F.floor(F.col("year") / 10) * 10).cast("int").alias("decade")).agg(F.count("*").alias("c"))
    peak = decades.agg(F.max_by("decade", F.struct("c", -F.col("decade"))).alias("decade"), F.max("c").alias("c"))
    return span.crossJoin(peak).select("oldest", "newest", (F.col("last") - F.col("first")).alias("span"), F.when(F.col("c") > F.col("n") * 0.5, F.col("decade")).alias("peak"))


def coverage_note(best: Column) -> Column:
    return F.when(best.isNull(), "empty").when(best < 0.30, "barely covered").when(best < 0.50, "tangential").otherwise("")


def lineages(shown: DataFrame, edges: DataFrame, first: int = 6, nodes: int = 5) -> DataFrame:
    """(a, b, hops): shortest directed path, either way, between the first papers, of 2 to ``nodes`` nodes."""
    ids = shown.where(F.col("rank") <= first).select(F.col("paper_id").alias("id"), "rank")
    found = G.hops(edges, ids.select("id"), nodes - 1).where("hops > 0")
    ranked = found.join(F.broadcast(ids.select(F.col("id").alias("source"), F.col("rank").alias("rs"))), "source").join(F.broadcast(ids.withColumnRenamed("rank", "rt")), "id")
    turned = ranked.select(F.when(F.col("rs") < F.col("rt"), F.col("source")).otherwise(F.col("id")).alias("a"), F.when(F.col("rs") < F.col("rt"), F.col("id")).otherwise(F.col("source")).alias("b"), "hops")
    return turned.groupBy("a", "b").agg(F.min("hops").alias("hops"))
