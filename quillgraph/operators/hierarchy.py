"""Adaptive cluster hierarchy: Ward linkage of a bounded set of vectors, level detection, assembly of nodes and edges.

Ward linkage is sequential; it runs in one task over at most MAX_POINTS points. Larger corpora are first reduced to
that many centroids by k-means, and papers follow their centroid.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.store import settled
from quillgraph.functions.vectors import dot, mean_pool

MAX_POINTS = 4_000
PCA_DIMENSIONS = 64
MIN_CLUSTER = 3
MAX_LEVELS = 8
CLUSTER_SIMILARITY = 0.25


def centred_components(x: np.ndarray, target: int = PCA_DIMENSIONS) -> np.ndarray:
    """Scores on the leading principal components of the centred rows; unchanged when there are no more dimensions than asked."""
    dim = min(target, x.shape[1], len(x) - 1)
    if dim >= x.shape[1]:
        return x
    u, s, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
    return u[:, :dim] * s[:dim]


def ward(x: np.ndarray, sizes: np.ndarray | None = None) -> np.ndarray:
    """Merges (left, right, distance, size) by rising distance: nearest-neighbour chains with the Lance-Williams update."""
    n = len(x)
    size = np.ones(n) if sizes is None else sizes.astype(float)
    sq = (x * x).sum(1)
    d = np.maximum(sq[:, None] + sq[None] - 2 * x @ x.T, 0) * (2 * size[:, None] * size[None] / (size[:, None] + size[None]))
    np.fill_diagonal(d, np.inf)
    alive, merges, chain = np.ones(n, bool), [], []
    weight = size.copy()
    while len(merges) < n - 1:
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        while True:
            i = chain[-1]
            row = np.where(alive, d[i], np.inf)
            j = int(np.argmin(row))
            if len(chain) > 1 and row[chain[-2]] <= row[j]:
                j = chain[-2]
                break
            chain.append(j)
        chain.pop(), chain.pop()
        merges.append((i, j, d[i, j]))
        total = weight[i] + weight[j] + weight
        new = ((weight[i] + weight) * d[i] + (weight[j] + weight) * d[j] - weight * d[i, j]) / total
        alive[j] = False
        weight[i] += weight[j]
        d[i], d[:, i] = new, new
        d[i, i] = np.inf
    order = sorted(range(len(merges)), key=lambda k: merges[k][2])
    # Slots become cluster numbers: points 0..n-1, the k-th merge n + k.
    parent = list(range(2 * n - 1))
    count = [1] * n + [0] * (n - 1)

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = np.zeros((n - 1, 4))
    for k, m in enumerate(order):
        i, j, dist = merges[m]
        a, b = sorted((top(i), top(j)))
        parent[a] = parent[b] = n + k
        count[n + k] = count[a] + count[b]
        out[k] = a, b, np.sqrt(dist), count[n + k]
    return out


def cut(merges: np.ndarray, distance: float | None = None, clusters: int | None = None) -> np.ndarray:
    """Labels from 0, numbered by first point: merges up to a distance, or as many as leave so many clusters."""
    n = len(merges) + 1
    taken = int(np.searchsorted(merges[:, 2], distance, "right")) if distance is not None else max(0, n - clusters)
    parent = list(range(2 * n - 1))

    def top(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for k in range(taken):
        parent[int(merges[k, 0])] = parent[int(merges[k, 1])] = n + k
    roots: dict[int, int] = {}
    return np.array([roots.setdefault(top(i), len(roots)) for i in range(n)])


def levels(merges: np.ndarray, smallest: int = MIN_CLUSTER, most: int = MAX_LEVELS) -> list[np.ndarray]:
    """Labellings at the jumps of the merge distances, finest first: where their second difference or their relative
    growth stands out, with about the square root of n clusters always among them."""
    n = len(merges) + 1
    z = merges[:, 2]
    if len(z) < 2:
        return []
    places: set[int] = set()
    if len(z) > 2:
        curve = np.diff(z, 2)
        places |= set((np.flatnonzero(curve > curve.mean() + 0.8 * curve.std()) + 1).tolist())
    growth = np.diff(z) / (z[:-1] + 1e-10)
    places |= set(np.flatnonzero(growth > np.percentile(growth, 75)).tolist())
    found: dict[int, np.ndarray] = {}
    for p in sorted(places):
        labels = cut(merges, distance=z[p])
        k = labels.max() + 1
        if smallest <= k <= n - smallest:
            found.setdefault(int(k), labels)
    root = max(2, int(np.sqrt(n)))
    if not any(abs(k - root) < 2 for k in found) and n >= 2 * smallest:
        found.setdefault(root, cut(merges, clusters=root))
    return [found[k] for k in sorted(found, reverse=True)[:most]]


def memberships(papers: DataFrame, smallest: int = MIN_CLUSTER, most: int = MAX_LEVELS) -> DataFrame:
    """(paper_id, level, cluster_id) from (paper_id, embedding): one task while there are at most MAX_POINTS papers."""
    if papers.limit(MAX_POINTS + 1).count() > MAX_POINTS:
        return _memberships_by_centroids(papers, smallest, most)

    def build(key, table):
        rows = sorted(zip(table["paper_id"].to_pylist(), table["embedding"].to_pylist(), strict=True))
        ids, x = [r[0] for r in rows], np.array([r[1] for r in rows], float)
        out = [(p, i + 1, f"L{i + 1}C{c}") for i, labels in enumerate(levels(ward(centred_components(x)), smallest, most) if len(ids) >= 3 else []) for p, c in zip(ids, labels.tolist(), strict=True)]
        return pa.table({"paper_id": pa.array([o[0] for o in out], pa.string()), "level": pa.array([o[1] for o in out], pa.int32()), "cluster_id": pa.array([o[2] for o in out], pa.string())})

    return papers.select("paper_id", "embedding").groupBy(F.lit(0).alias("all")).applyInArrow(build, "paper_id string, level int, cluster_id string")


def _memberships_by_centroids(papers: DataFrame, smallest: int, most: int) -> DataFrame:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    points = papers.select("paper_id", array_to_vector("embedding").alias("features"))
    model = KMeans(k=MAX_POINTS // 4, seed=1, maxIter=10).fit(points)
    placed = settled(model.transform(points).select("paper_id", F.col("prediction").alias("point")), "points")
    counts = {r.point: r.n for r in placed.groupBy("point").agg(F.count("*").alias("n")).collect()}
    centres = [(c, v) for c, v in enumerate(model.clusterCenters()) if c in counts]
    x, sizes = np.array([v for _, v in centres]), np.array([counts[c] for c, _ in centres])
    rows = [(c, i + 1, f"L{i + 1}C{k}") for i, labels in enumerate(levels(ward(x, sizes), smallest, most)) for (c, _), k in zip(centres, labels.tolist(), strict=True)]
    table = papers.sparkSession.createDataFrame(rows, "point int, level int, cluster_id string")
    return placed.join(F.broadcast(table), "point").select("paper_id", "level", "cluster_id")  # MAX_POINTS x MAX_LEVELS rows at most


def assembled(papers: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (cluster_id, level, size, centroid) and edges (src, dst, etype, weight): membership and similarity of clusters."""
    members = settled(members, "members")
    vectors = members.join(papers.select("paper_id", "embedding"), "paper_id").withColumn("one", F.lit(1.0))
    centroids = mean_pool(vectors, "embedding", "one", ["level", "cluster_id"]).withColumnRenamed("pooled", "centroid")
    nodes = settled(members.groupBy("level", "cluster_id").agg(F.count("*").alias("size")).join(centroids, ["level", "cluster_id"]), "clusters")
    leaf = members.where("level = 1").select(F.col("paper_id").alias("src"), F.col("cluster_id").alias("dst"))
    below = members.select("paper_id", (F.col("level") + 1).alias("level"), F.col("cluster_id").alias("src"))
    inner = members.join(below, ["paper_id", "level"]).select("src", F.col("cluster_id").alias("dst")).distinct()
    member = leaf.unionByName(inner).select("src", "dst", F.lit("member").alias("etype"), F.lit(1.0).alias("weight"))
    a, b = nodes.select("level", F.col("cluster_id").alias("src"), F.col("centroid").alias("va")), nodes.select("level", F.col("cluster_id").alias("dst"), F.col("centroid").alias("vb"))
    alike = a.join(b, "level").where("src <> dst").withColumn("weight", dot("va", "vb")).where(F.col("weight") > CLUSTER_SIMILARITY)
    return nodes, member.unionByName(alike.select("src", "dst", F.lit("cluster_sim").alias("etype"), "weight"))


def peaks(merges: DataFrame, order: str = "step", value: str = "distance") -> DataFrame:
    """(step, distance, curve_peak, growth_peak): where a list of merge distances bends or grows most. The list is one ordered series."""
    w = Window.orderBy(order)
    z = F.col(value)
    steps = merges.select(order, z.alias("distance"), F.lead(z, 1).over(w).alias("n1"), F.lag(z, 1).over(w).alias("p1"), F.row_number().over(w).alias("_i"))
    facts = steps.withColumn("curve", F.col("n1") - 2 * F.col("distance") + F.col("p1")).withColumn("growth", (F.col("n1") - F.col("distance")) / (F.col("distance") + 1e-10))
    limits = facts.agg((F.avg("curve") + 0.8 * F.stddev_pop("curve")).alias("cl"), F.expr("percentile(growth, 0.75)").alias("gl"))
    marked = facts.crossJoin(F.broadcast(limits))
    return marked.select(order, "distance", F.coalesce(F.col("curve") > F.col("cl"), F.lit(False)).alias("curve_peak"), F.coalesce(F.col("growth") > F.col("gl"), F.lit(False)).alias("growth_peak"))
