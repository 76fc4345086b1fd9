"""Slates: floors, exploration and greedy diversification."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.store import settled, small
from quillgraph.functions.vectors import dot

PPR_ROUNDS = 15
RELEVANCE_FLOOR = 0.30
EXPLORE_FLOOR = 0.25
MIN_NOVELTY = 0.30
LAMBDA = 0.7


def top(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows with their rank from 1: a distributed top-n, then a window over n rows only."""
    first = df.orderBy(*order).limit(n)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def numbered(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """All rows with their position in the order, from 1: sorted by ranges, then each range is offset by the rows before it."""
    keyed = df.withColumn("_key", F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)]))
    ranged = keyed.repartitionByRange("_key").sortWithinPartitions("_key").withColumn("_part", F.spark_partition_id())
    ranged = settled(ranged, "ranged")
    counts = ranged.groupBy("_part").agg(F.count("*").alias("n"))  # one row a range
    before = counts.withColumn("_before", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("_key"))
    return ranged.withColumn("_inside", inside).join(F.broadcast(before), "_part").withColumn(name, (F.col("_inside") + F.col("_before")).cast("long")).drop("_part", "_key", "_inside", "_before")


def explore_scores(relevance: DataFrame, gaps: DataFrame, floor: float = EXPLORE_FLOOR) -> DataFrame:
    """(…, explore): novelty, affinity to under-covered niches and relevance, of candidates above the floors."""
    able = relevance.where((F.col("novelty") >= MIN_NOVELTY) & (F.col("rel") >= floor))
    near = able.select("paper_id", "embedding").crossJoin(small(gaps.select("centroid"), 4096)).groupBy("paper_id").agg(F.max(dot("embedding", "centroid")).alias("affinity"))
    return able.join(near, "paper_id").withColumn("explore", F.col("novelty") * 0.3 + F.col("affinity") * 0.5 + F.col("rel") * 0.2).where("explore > 0")


def slate(relevance: DataFrame, n: int, ratio: float, floor: float = RELEVANCE_FLOOR, explore_floor: float = EXPLORE_FLOOR) -> DataFrame:
    """(paper_id, label, rank, value): the best by relevance, then by novelty among the others."""
    explore = 0 if n <= 1 else max(1, int(n * ratio))
    both = settled(relevance.select("paper_id", "rel", "novelty"), "relevance")
    best = top(both.where(F.col("rel") >= floor), [F.desc(F.round("rel", 9)), F.col("paper_id")], n - explore)
    best = best.select("paper_id", F.lit("relevant").alias("label"), "rank", F.col("rel").alias("value"))
    others = both.where((F.col("rel") >= explore_floor) & (F.col("novelty") >= MIN_NOVELTY)).join(F.broadcast(best.select("paper_id")), "paper_id", "left_anti")
    new = top(others, [F.desc(F.round("novelty", 9)), F.col("paper_id")], explore)
    return best.unionByName(new.select("paper_id", F.lit("explore").alias("label"), "rank", F.col("novelty").alias("value")))


def greedy(scores: np.ndarray, vectors: np.ndarray, n: int, trade: float = LAMBDA) -> list[int]:
    """Positions picked in order: each maximises trade * score - (1 - trade) * likeness to what is picked; ties keep the earlier."""
    picked: list[int] = []
    redundancy = np.zeros(len(scores))
    free = np.ones(len(scores), bool)
    while free.any() and len(picked) < n:
        value = np.where(free, trade * scores - (1 - trade) * redundancy, -np.inf)
        best = int(np.flatnonzero(value >= value.max() - 1e-12)[0])
        picked.append(best)
        free[best] = False
        like = vectors @ vectors[best]
        redundancy = like if len(picked) == 1 else np.maximum(redundancy, like)
    return picked


def _best(values: DataFrame) -> tuple | None:
    """(id, score, embedding) of the largest value, up to rounding; ties to the larger score, then the smaller id."""
    return values.orderBy(F.desc(F.round("value", 11)), F.desc("score"), "id").select("id", "score", "embedding").first()


def _after(rows: DataFrame, best: tuple, first: bool) -> DataFrame:
    """The rows without the pick, with their likeness to all picks so far."""
    like = dot("embedding", F.array(*[F.lit(float(x)) for x in best[2]]))
    return rows.where(F.col("id") != best[0]).withColumn("like", like if first else F.greatest("like", like))


def _slate(rows: DataFrame, picked: list[tuple]) -> DataFrame:
    kind = rows.schema["id"].dataType.simpleString()
    return rows.sparkSession.createDataFrame([(p[0], i + 1, float(p[1])) for i, p in enumerate(picked)], f"id {kind}, rank int, score double")


def diversified(pool: DataFrame, n: int, trade: float = LAMBDA) -> DataFrame:
    """(id, rank, score) of a greedy slate over (id, score, embedding): a distributed arg-max a round over all rows."""
    pool = settled(pool.select("id", F.col("score").cast("double").alias("score"), "embedding"), "pool")
    rows, picked = pool.withColumn("like", F.lit(0.0)), []
    while len(picked) < n:
        best = _best(rows.withColumn("value", trade * F.col("score") - (1 - trade) * F.col("like")))
        if best is None:
            break
        picked.append(best)
        rows = _after(rows, best, len(picked) == 1)
    return _slate(pool, picked)


def scout_slate(pool: DataFrame, n: int = 12) -> DataFrame:
    """(id, rank, score): by falling score, whoever keeps a positive margin over its likeness to those accepted.

    From the first pick on likeness only grows, so who once falls out never returns, and each round accepts the best left.
    """
    pool = settled(pool.select("id", F.col("score").cast("double").alias("score"), "embedding"), "pool")
    rows, picked = pool.withColumn("like", F.lit(0.0)), []
    while len(picked) < n:
        able = rows.where(LAMBDA * F.col("score") - (1 - LAMBDA) * F.col("like") > 0)
        best = able.orderBy(F.desc("score"), "id").select("id", "score", "embedding").first()
        if best is None:
            break
        picked.append(best)
        rows = _after(able if len(picked) > 1 else rows, best, len(picked) == 1)
    return _slate(pool, picked)
