"""Layered graphs as edge tables: upserts, degrees, paths, ranks, components, cycles, topology.

Edges are (src, dst, weight, ...) in one table with a layer column, or one table a layer. Iterative operators write
their state every few rounds and never hold it on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.store import settled

#: Rounds of an iteration between two written states. A written state has a known size, so that Spark can broadcast a
#: small one to the arcs instead of shuffling them.
ROUNDS_PER_WRITE = 1


def upsert_nodes(nodes: DataFrame, new: DataFrame, key: str = "id", order: str = "version") -> DataFrame:
    """Latest row of each key over old and new rows."""
    both = nodes.unionByName(new, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def upsert_edges(edges: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("layer", "src", "dst")) -> DataFrame:
    """Merge by key; attributes given by ``new`` win, others stay."""
    values = [c for c in edges.columns if c not in keys]
    joined = edges.alias("o").join(new.alias("n"), list(keys), "full_outer")
    pick = [F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) if c in new.columns else F.col(f"o.{c}") for c in values]
    return joined.select(*keys, *pick)


def remove_edges(edges: DataFrame, gone: DataFrame, keys: tuple[str, ...] = ("src", "dst")) -> DataFrame:
    return edges.join(gone, list(keys), "left_anti")


def overlay(semantic: DataFrame, citation: DataFrame) -> DataFrame:
    """(src, dst, weight, etype): both layers, citation attributes winning on shared pairs."""
    c = citation.select("src", "dst", F.col("weight").alias("cw"), F.col("etype").alias("ce"))
    s = semantic.select("src", "dst", F.col("weight").alias("sw"), F.col("etype").alias("se"))
    return s.join(c, ["src", "dst"], "full_outer").select("src", "dst", F.coalesce("cw", "sw").alias("weight"), F.coalesce("ce", "se").alias("etype"))


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b, weight), a < b: the larger weight of both directions; self-loops go."""
    pairs = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.coalesce("weight", F.lit(1.0)).alias("weight"))
    return pairs.groupBy("a", "b").agg(F.max("weight").alias("weight"))


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight").unionByName(pairs.select(F.col("b").alias("src"), F.col("a").alias("dst"), "weight"))


def degrees(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, degree): in plus out; a self-loop counts twice. With ``nodes``, isolated ones have 0."""
    d = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return d if nodes is None else nodes.select("id").join(d, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among ``ids``."""
    return edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")


def hops(edges: DataFrame, sources: DataFrame, limit: int) -> DataFrame:
    """(source, id, hops): unweighted shortest directed distances of up to ``limit`` hops, the source itself at 0.

    One frontier join a hop; a pair found once is never expanded again.
    """
    arcs = edges.select("src", "dst").distinct()
    frontier = sources.select(F.col("id").alias("source"), "id").withColumn("hops", F.lit(0))
    seen = frontier
    for hop in range(1, limit + 1):
        step = frontier.join(arcs, frontier.id == arcs.src).select("source", F.col("dst").alias("id")).distinct()
        frontier = step.join(seen.select("source", "id"), ["source", "id"], "left_anti").withColumn("hops", F.lit(hop))
        if hop % 2 == 0 and hop < limit:
            frontier = settled(frontier, "frontier")
        seen = seen.unionByName(frontier)
    return seen


def pagerank(nodes: DataFrame, edges: DataFrame, restart: DataFrame | None = None, alpha: float = 0.85, rounds: int = 15) -> DataFrame:
    """(id, rank) after ``rounds`` power steps over (src, dst, weight).

    ``restart``: (id, share), shares summing to one; uniform without. What dangling nodes hold goes to the restart.
    """
    n = nodes.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("rank"))
    share = F.lit(1.0 / n) if restart is None else F.coalesce("share", F.lit(0.0))
    base = nodes.select("id") if restart is None else nodes.select("id").join(restart, "id", "left")
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    base = settled(base.join(out, base.id == out.src, "left").select("id", share.alias("p"), F.col("total").isNull().alias("dangling")), "rank-nodes")
    arcs = settled(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("part")), "rank-arcs")
    loose = base.where("dangling").limit(1).count() > 0
    ranks = base.select("id", F.lit(1.0 / n).alias("rank"))
    for i in range(rounds):
        # One number a round; without dangling nodes nothing is lost and rounds need no look at the state.
        lost = ranks.join(base.where("dangling"), "id").agg(F.sum("rank")).first()[0] if loose else 0.0
        flow = ranks.join(arcs, ranks.id == arcs.src).groupBy("dst").agg(F.sum(F.col("rank") * F.col("part")).alias("flow"))
        new = base.join(flow, base.id == flow.dst, "left")
        ranks = new.select("id", (alpha * (F.coalesce("flow", F.lit(0.0)) + F.lit(float(lost or 0.0)) * F.col("p")) + (1 - alpha) * F.col("p")).alias("rank"))
        if loose or (i + 1) % ROUNDS_PER_WRITE == 0 and i + 1 < rounds:
            ranks = settled(ranks, "ranks")
    return ranks


def network_mass(nodes: DataFrame, edges: DataFrame, restart: DataFrame, alpha: float = 0.85, rounds: int = 15) -> DataFrame:
    """(id, mass): personalised rank without what the restart put there directly, against its peak. Empty without edges."""
    total = restart.agg(F.sum("weight")).first()[0]
    shares = settled(restart.select("id", (F.col("weight") / F.lit(float(total or 1.0))).alias("share")), "restart")
    pairs = settled(undirected(edges), "network")
    ranks = pagerank(nodes, both_ways(pairs), shares, alpha, rounds).join(shares, "id", "left")
    return _against_peak(ranks, alpha)


def packed_mass(places: DataFrame, arcs: DataFrame, restart: DataFrame, alpha: float = 0.85, rounds: int = 15) -> DataFrame:
    """``network_mass`` over packed arcs (``layers.packed``)."""
    from quillgraph.operators import layers

    total = restart.agg(F.sum("weight")).first()[0]
    shares = restart.select("id", (F.col("weight") / F.lit(float(total or 1.0))).alias("share"))
    return _against_peak(layers.walk(places, arcs, shares, alpha, rounds), alpha)


def _against_peak(ranks: DataFrame, alpha: float) -> DataFrame:
    net = settled(ranks.select("id", F.greatest(F.lit(0.0), (F.col("rank") - (1 - alpha) * F.coalesce("share", F.lit(0.0))) / alpha).alias("net")), "net")
    peak = net.agg(F.max("net").alias("peak"))
    return net.crossJoin(F.broadcast(peak)).where("peak > 0").select("id", (F.col("net") / F.col("peak")).alias("mass"))


def cyclic_core(edges: DataFrame, limit: int = 200) -> DataFrame:
    """The edges left when nodes without incoming or without outgoing edges are peeled off again and again."""
    core = settled(edges.select("src", "dst").distinct(), "core")
    size = core.count()
    for _ in range(limit):
        if not size:
            break
        core = core.join(core.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(core.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
        core = settled(core, "core")
        left = core.count()
        if left == size:
            break
        size = left
    return core


def is_dag(edges: DataFrame) -> bool:
    return cyclic_core(edges).limit(1).count() == 0


def topological_levels(edges: DataFrame, nodes: DataFrame, limit: int = 50) -> DataFrame:
    """(id, level): the longest path that leads to each node of an acyclic graph."""
    levels = nodes.select("id", F.lit(0).alias("level"))
    arcs = edges.select("src", "dst").distinct()
    mark = None
    for _ in range(limit):
        after = levels.join(arcs, levels.id == arcs.src).groupBy("dst").agg(F.max(F.col("level") + 1).alias("up"))
        levels = settled(levels.join(after, levels.id == after.dst, "left").select("id", F.greatest("level", F.coalesce("up", F.lit(0))).alias("level")), "levels")
        total = levels.agg(F.sum("level")).first()[0]
        if total == mark:
            return levels
        mark = total
    raise ValueError("the graph has a cycle, or paths longer than the limit")


def components(nodes: DataFrame, edges: DataFrame, limit: int = 100) -> DataFrame:
    """(id, component): the smallest id reachable, edges taken both ways. Labels jump to their labels' labels each round."""
    arcs = settled(edges.where("src <> dst").select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")).select("e.*").distinct(), "arcs")
    labels = settled(nodes.select("id", F.col("id").alias("component")), "labels")
    for _ in range(limit):
        near = arcs.join(labels, arcs.dst == labels.id).groupBy("src").agg(F.min("component").alias("least"))
        low = labels.join(near, labels.id == near.src, "left").select("id", "component", F.least("component", F.coalesce("least", "component")).alias("new"))
        jump = labels.select(F.col("id").alias("new"), F.col("component").alias("root"))
        now = settled(low.join(jump, "new").select("id", F.least("new", "root").alias("new"), "component"), "labels")
        changed = now.where("new <> component").limit(1).count()
        labels = now.select("id", F.col("new").alias("component"))
        if not changed:
            return labels
    raise RuntimeError("the components did not settle")


def triangles(pairs: DataFrame) -> DataFrame:
    """(id, triangles) over undirected (a, b): each edge points from the end of smaller degree, so hubs stay narrow."""
    d = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("d"))
    da, db = (d.select(F.col("id").alias(x), F.col("d").alias(f"d{x}")) for x in "ab")
    low = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    arcs = pairs.join(da, "a").join(db, "b").select(F.when(low, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(low, F.col("b")).otherwise(F.col("a")).alias("y"))
    wedges = arcs.join(arcs.select("x", F.col("y").alias("z")), "x").where("y < z")
    closed = wedges.join(pairs.select(F.col("a").alias("y"), F.col("b").alias("z")), ["y", "z"])
    return closed.select(F.explode(F.array("x", "y", "z")).alias("id")).groupBy("id").agg(F.count("*").alias("triangles"))


def topology(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of whole-graph measures of the undirected view: sizes, density, degree, clustering, transitivity, centralisation, largest component."""
    pairs = settled(undirected(edges), "pairs")
    deg = degrees(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")), nodes).join(triangles(pairs), "id", "left").withColumn("t", F.coalesce("triangles", F.lit(0)))
    d = F.col("degree")
    local = F.when(d >= 2, 2.0 * F.col("t") / (d * (d - 1))).otherwise(0.0)
    wide = deg.agg(
        F.count("*").alias("n"), F.sum("degree").alias("ends"), F.avg("degree").alias("avg_degree"), F.max("degree").alias("max_degree"), F.avg(local).alias("clustering"),
        F.sum("t").alias("corners"), F.sum(d * (d - 1) / 2).alias("wedges"),
    )
    sizes = components(nodes, pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"))).groupBy("component").agg(F.count("*").alias("size")).agg(F.max("size").alias("largest"), F.count("*").alias("components"))
    n = F.col("n")
    return wide.crossJoin(sizes).select(
        n.alias("nodes"), (F.col("ends") / 2).cast("long").alias("edges"), F.when(n > 1, F.col("ends") / (n * (n - 1))).otherwise(0.0).alias("density"), "avg_degree", "clustering",
        F.when(F.col("wedges") > 0, F.col("corners") / F.col("wedges")).otherwise(0.0).alias("transitivity"),
        F.when(n > 2, (n * F.col("max_degree") - F.col("ends")) / ((n - 1) * (n - 2))).otherwise(0.0).alias("centralisation"),
        "components", (F.col("largest") / n).alias("largest_fraction"),
    )


#: Nodes of a largest component whose paths are measured; all pairs of them are found.
PATH_NODES = 2_000


def largest_paths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: size of the largest component (of equal ones, that of the smallest id), mean and longest shortest path in it.

    Edges count both ways and without weights. Both are 0 for a single node, and null above PATH_NODES nodes, as the
    pairs are the square of the nodes.
    """
    labels = settled(components(nodes, edges), "labels")
    top = settled(labels.groupBy("component").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "component").limit(1), "largest")
    size = sum(r[0] for r in top.select("size").collect())
    if not 1 < size <= PATH_NODES:
        lengths = F.lit(0.0 if size == 1 else None).cast("double")
        return top.select(F.col("size").alias("nodes"), lengths.alias("mean_path"), lengths.alias("diameter"))
    inside = labels.join(F.broadcast(top), "component").select("id")
    arcs = settled(both_ways(undirected(induced(edges, inside))).select("src", "dst"), "arcs")
    seen = frontier = settled(inside.select(F.col("id").alias("source"), "id").withColumn("hops", F.lit(0)), "seen")
    while frontier.limit(1).count():
        step = frontier.join(arcs, frontier.id == arcs.src).select("source", F.col("dst").alias("id"), F.col("hops") + 1).distinct().toDF("source", "id", "hops")
        frontier = settled(step.join(seen, ["source", "id"], "left_anti"), "frontier")
        seen = settled(seen.unionByName(frontier), "seen")
    return seen.agg(F.lit(size).cast("long").alias("nodes"), (F.sum("hops") / (float(size) * (size - 1))).alias("mean_path"), F.max("hops").cast("double").alias("diameter"))


def modularity(nodes: DataFrame, edges: DataFrame, communities: DataFrame) -> DataFrame:
    """One row: weighted modularity of a given partition (id, community) over undirected edges."""
    pairs = undirected(edges)
    c = communities.select("id", "community")
    ends = pairs.join(c.select(F.col("id").alias("a"), F.col("community").alias("ca")), "a").join(c.select(F.col("id").alias("b"), F.col("community").alias("cb")), "b")
    inside = ends.where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.sum("weight").alias("inside"))
    reach = both_ways(pairs).join(c, F.col("src") == c.id).groupBy("community").agg(F.sum("weight").alias("reach"))
    total = pairs.agg(F.sum("weight").alias("m"))
    by = reach.join(inside, "community", "left").crossJoin(F.broadcast(total))
    return by.agg(F.coalesce(F.sum(F.coalesce("inside", F.lit(0.0)) / F.col("m") - F.pow(F.col("reach") / (2 * F.col("m")), F.lit(2))), F.lit(0.0)).alias("modularity"))


def edge_types(edges: DataFrame) -> DataFrame:
    return edges.groupBy("layer", "etype").agg(F.count("*").alias("n"))
