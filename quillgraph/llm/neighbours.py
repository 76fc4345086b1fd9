"""Approximate nearest neighbours by an inverted multi-index.

The two halves of the vectors are quantised separately (k-means on a bounded sample), so that a pair of centroids
names a cell. Every vector is put in its cell. A query walks the centroid pairs by their summed squared distance,
smallest first, with a heap, until the cells it has seen hold a calibrated share of all entries; the entries of those
cells are reranked by their true Euclidean distance in double precision. The share is measured on the fitting sample,
against brute force there, as what RECALL asks for.

Cells are gathered into shards of at most SHARD_ROWS entries (a larger cell is split by a hash of vec_id), a query goes
only to shards that hold one of its cells, and each shard streams its queries past its entries: memory is bounded by
the shard, and what leaves it is K rows a query. Centroids and cell counts number MAX_CENTROIDS^2 at most.

Vectors of different dimensions have no distance: each dimension of the table is searched by itself. A dimension of at
most FEW_ROWS vectors needs no index; all such dimensions are answered by brute force, a group a dimension.

Defined results: vectors that are null, empty, all zero, or that hold null or non-finite components take no part, nor do
rows without vec_id; ties go to the smaller vec_id; rows that repeat a vec_id are each candidates, but a query runs once
(its smallest vector of each dimension); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import record, table

K = 10
SAMPLE_ROWS = 16_384
SAMPLE_QUERIES = 128
MAX_CENTROIDS = 256
ROWS_PER_CELL = 32
#: Entries of a shard: about a MOST_SHARDS-th of all, between these bounds. More shards spread the work of few rows,
#: larger ones repeat fewer queries.
MOST_SHARDS = 256
LEAST_SHARD_ROWS, SHARD_ROWS = 512, 65_536
RECALL = 0.97
#: Vectors of a dimension up to which it is searched by brute force, in one group.
FEW_ROWS = 512


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.choice(len(x), k)])
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(1) / 2
    return np.concatenate([np.argmin(half - x[i : i + 8192] @ c.T, axis=1) for i in range(0, len(x), 8192)] or [np.empty(0, np.int64)])


class Index:
    """Centroids of both halves, the entries in each cell, and the share of entries that a query visits."""

    def __init__(self, first: np.ndarray, second: np.ndarray, share: float = 1.0):
        self.first, self.second, self.share = first, second, share
        self.counts = np.zeros(len(first) * len(second), np.int64)

    def cells(self, x: np.ndarray) -> np.ndarray:
        h = self.first.shape[1]
        return nearest(x[:, :h], self.first) * len(self.second) + nearest(x[:, h:], self.second)

    def walk(self, q: np.ndarray, entries: float) -> np.ndarray:
        """Non-empty cells by the summed distance of their centroids, until they hold so many entries."""
        h = self.first.shape[1]
        d1, d2 = ((self.first - q[:h]) ** 2).sum(1), ((self.second - q[h:]) ** 2).sum(1)
        o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
        d1, d2, o1, o2 = d1[o1].tolist(), d2[o2].tolist(), o1.tolist(), o2.tolist()
        n2, counts = len(o2), self.counts
        heap, out, seen = [(d1[0] + d2[0], 0, 0)], [], 0
        while heap and seen < entries:
            _, i, j = heapq.heappop(heap)
            # Each pair enters once: along a row from its left, and down the first column.
            if j + 1 < n2:
                heapq.heappush(heap, (d1[i] + d2[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(d1):
                heapq.heappush(heap, (d1[i + 1] + d2[0], i + 1, 0))
            cell = o1[i] * n2 + o2[j]
            if n := int(counts[cell]):
                out.append(cell)
                seen += n
        return np.array(out, np.int64)


def fit(sample: np.ndarray, n_rows: int) -> Index:
    """Centroids from the sample; the share such that RECALL of the sample's true neighbours are in visited cells."""
    k = int(min(MAX_CENTROIDS, max(4, round((n_rows / ROWS_PER_CELL) ** 0.5))))
    h = sample.shape[1] // 2
    index = Index(k_means(sample[:, :h], k), k_means(sample[:, h:], k))
    cells = index.cells(sample)
    index.counts = np.bincount(cells, minlength=len(index.counts))
    needed = []
    step = max(1, len(sample) // SAMPLE_QUERIES)
    for i in range(0, len(sample), step):
        q = sample[i]
        d = ((sample - q) ** 2).sum(1)
        d[i] = np.inf
        true = np.argsort(d, kind="stable")[: min(K, len(sample) - 1)]
        order = index.walk(q, np.inf)
        # Entries seen once the cell of each true neighbour has been visited.
        seen = dict(zip(order.tolist(), np.cumsum(index.counts[order]).tolist(), strict=True))
        needed += [seen[c] / len(sample) for c in cells[true].tolist()]
    if needed:
        index.share = float(min(1.0, np.quantile(needed, RECALL)))
    return index


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles) of the rows that can take part, whatever their dimension."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where("vec_id is not null")
    return rows.where("embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(embedding, x -> x <> 0)")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


_ROWS = pa.schema([("shard", pa.int64()), ("asks", pa.bool_()), ("vec_id", pa.int64()), ("embedding", pa.list_(pa.float64())), ("cells", pa.list_(pa.int32()))])
_ROWS_SQL = "shard long, asks boolean, vec_id long, embedding array<double>, cells array<int>"
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def best(q: np.ndarray, ids: np.ndarray, x: np.ndarray, own: int, k: int, rough: np.ndarray) -> list[tuple[int, float]]:
    """The k nearest of x by the exact distance, ties to the smaller id; ``rough`` holds nearly exact squares."""
    keep = np.flatnonzero(ids != own)
    if len(keep) > k:
        r = rough[keep]
        keep = keep[r <= np.partition(r, k - 1)[k - 1] + 1e-9 * (1 + float(q @ q))]
    d = np.sqrt(((x[keep] - q) ** 2).sum(1))
    at = np.lexsort((ids[keep], d))[:k]
    return list(zip(ids[keep][at].tolist(), d[at].tolist(), strict=True))


def search(vectors: DataFrame, asking: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vector of ``asking`` its k nearest found among ``vectors`` of its dimension."""
    rows, queries = (usable(x).withColumn("dim", F.size("embedding")) for x in (vectors, asking))
    queries = queries.groupBy("dim", "vec_id").agg(F.min("embedding").alias("embedding"))
    counts = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    few = sorted(d for d, n in counts.items() if n <= FEW_ROWS)
    found = vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score double")
    for dim in sorted(counts.keys() - set(few)):
        found = found.unionByName(searched(*(x.where(F.col("dim") == dim).drop("dim") for x in (rows, queries)), dim, counts[dim], k))
    if few:
        found = found.unionByName(compared(*(x.where(F.col("dim").isin(few)) for x in (rows, queries)), k))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def compared(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score) by brute force inside each dimension, which holds FEW_ROWS at most."""

    def run(key, table):
        dim = key[0].as_py()
        asks = table["asks"].to_numpy()
        ids, x = table["vec_id"].to_numpy(), _matrix(table["embedding"].combine_chunks(), dim)
        e_ids, e = ids[~asks], x[~asks]
        out = [(int(i), v, d) for i, q in zip(ids[asks], x[asks], strict=True) for v, d in best(q, e_ids, e, i, k, ((e - q) ** 2).sum(1))]
        return pa.table([pa.array([r[i] for r in out], f.type) for i, f in enumerate(_FOUND)], schema=_FOUND)

    marked = [x.select("dim", F.lit(asks).alias("asks"), "vec_id", "embedding") for x, asks in ((rows, False), (queries, True))]
    return marked[0].unionByName(marked[1]).groupBy("dim").applyInArrow(run, "query_id long, vec_id long, score double")


def searched(rows: DataFrame, queries: DataFrame, dim: int, n: int, k: int) -> DataFrame:
    """(query_id, vec_id, score) by the index, all vectors of one dimension: k a shard, of which the best k count."""
    if dim == 1:  # two halves are needed
        rows, queries = (x.withColumn("embedding", F.concat("embedding", F.array(F.lit(0.0)))) for x in (rows, queries))
        dim = 2
    chance = F.pmod(F.xxhash64("vec_id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(chance < min(1.0, SAMPLE_ROWS / n)).orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(2 * SAMPLE_ROWS)
    sample = np.array([r.embedding for r in sample.collect()], float).reshape(-1, dim)
    if not len(sample):
        sample = np.array([r.embedding for r in rows.limit(1).collect()], float)
    index = fit(sample, n)

    def placed(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(index.cells(_matrix(batch.column("embedding"), dim)).astype(np.int32)), batch.column("vec_id"), batch.column("embedding")], ["cell", "vec_id", "embedding"])

    entries = rows.select("vec_id", "embedding").mapInArrow(placed, "cell int, vec_id long, embedding array<double>")
    index.counts = np.zeros_like(index.counts)
    for r in entries.groupBy("cell").agg(F.count("*").alias("n")).collect():  # at most MAX_CENTROIDS^2 rows
        index.counts[r.cell] = r.n
    # Cells in order fill shards; a cell above a shard's size has several of its own.
    shard_rows = min(SHARD_ROWS, max(LEAST_SHARD_ROWS, n // MOST_SHARDS))
    split = np.maximum(1, -(-index.counts // shard_rows))
    first, at, filled = np.zeros(len(split), np.int64), 0, 0
    for c, (m, s) in enumerate(zip(index.counts.tolist(), split.tolist(), strict=True)):
        if filled and (s > 1 or filled + m > shard_rows):
            at, filled = at + 1, 0
        first[c], filled = at, filled + m
        if s > 1:
            at, filled = at + s, 0
    wanted = index.share * n

    def as_entries(batches):
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("embedding"), dim)
                cell, ids = index.cells(x), batch.column("vec_id").to_numpy()
                part = (ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % split[cell]
                yield record(_ROWS, shard=pa.array(first[cell] + part), asks=pa.array(np.zeros(len(ids), bool)), vec_id=batch.column("vec_id"), embedding=batch.column("embedding"), cells=pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32)), pa.array(cell.astype(np.int32))))

    def as_queries(batches):
        for batch in batches:
            for vec_id, q in zip(batch.column("vec_id").to_pylist(), _matrix(batch.column("embedding"), dim) if batch.num_rows else (), strict=True):
                cells = index.walk(q, wanted)
                shards = first[cells]
                out = []
                for s in np.unique(shards).tolist():
                    own = cells[shards == s]
                    out += [(s + i, own) for i in range(int(split[own].max()))]
                yield record(_ROWS, shard=[s for s, _ in out], asks=[True] * len(out), vec_id=[vec_id] * len(out), embedding=[q.tolist()] * len(out), cells=[c.tolist() for _, c in out])

    def answered(batches):
        shard, held, x = None, [], None
        for batch in batches:
            out = []
            shards, asks = batch.column("shard").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
            ids, vectors_, cells = batch.column("vec_id").to_numpy(), batch.column("embedding"), batch.column("cells")
            cuts = np.flatnonzero(np.concatenate([[True], (shards[1:] != shards[:-1]) | (asks[1:] != asks[:-1])])).tolist() + [len(shards)] if len(shards) else []
            for a, b in zip(cuts, cuts[1:], strict=False):
                if shards[a] != shard:
                    shard, held, x = shards[a], [], None
                part = _matrix(vectors_.slice(a, b - a), dim)
                if not asks[a]:
                    held.append((ids[a:b], cells.slice(a, b - a).flatten().to_numpy(), part))
                    x = None
                    continue
                if not held:
                    continue
                if x is None:
                    e_ids, e_cells, x = (np.concatenate([h[i] for h in held]) for i in range(3))
                    order = np.argsort(e_cells, kind="stable")
                    e_ids, e_cells, x = e_ids[order], e_cells[order], x[order]
                    squares = (x * x).sum(1)
                for i in range(a, b, 32):
                    asked = [cells[j].values.to_numpy() for j in range(i, min(i + 32, b))]
                    near = np.flatnonzero(np.isin(e_cells, np.unique(np.concatenate(asked))))
                    q = part[i - a : i - a + len(asked)]
                    rough = squares[near] - 2 * q @ x[near].T
                    for j, visited in enumerate(asked):
                        own = np.flatnonzero(np.isin(e_cells[near], visited))
                        at_ = near[own]
                        out += [(int(ids[i + j]), v, d) for v, d in best(q[j], e_ids[at_], x[at_], ids[i + j], k, rough[j][own])]
            yield record(_FOUND, query_id=[r[0] for r in out], vec_id=[r[1] for r in out], score=[r[2] for r in out])

    both = rows.select("vec_id", "embedding").mapInArrow(as_entries, _ROWS_SQL).unionByName(queries.select("vec_id", "embedding").mapInArrow(as_queries, _ROWS_SQL))
    return both.repartition("shard").sortWithinPartitions("shard", "asks", "vec_id").mapInArrow(answered, "query_id long, vec_id long, score double")


def op5_multi_index_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 100 = 0"))


QUERIES = {"op5_multi_index_neighbours": op5_multi_index_neighbours}
ORACLES: dict[str, str] = {}
