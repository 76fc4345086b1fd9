"""Exact similarity joins of unit vectors, block against block."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block, about; a task holds two blocks.
BLOCK_ROWS = 2_048


def similar_pairs(vectors: DataFrame, threshold: float, group: str | None = None) -> DataFrame:
    """(a, b, weight) with a < b and inner product of at least ``threshold``, within ``group`` if given.

    Rows are dealt into blocks by a hash of their id, and every pair of blocks meets in one task as two small
    matrices: memory is bounded, and the threshold is applied before anything leaves the task.
    """
    keys = [group] if group else []
    n = vectors.count()
    blocks = max(1, -(-n // BLOCK_ROWS))
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    rows = vectors.select(F.col("id").cast("string").alias("id"), F.col("embedding").cast("array<double>"), *keys).withColumn("block", own)
    # A block meets itself and every other one: the pair is named by its smaller, then its larger block.
    others = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dealt = rows.withColumn("other", others).withColumn("x", F.least("block", "other")).withColumn("y", F.greatest("block", "other"))
    names = ["a", "b", "weight", *keys]

    def pairs(table: pa.Table) -> pa.Table:
        ids = np.array(table["id"].to_pylist(), object)
        x, y = table["x"][0].as_py(), table["y"][0].as_py()
        block = table["block"].to_numpy()
        v = np.array(table["embedding"].to_pylist(), float)
        left, right = np.flatnonzero(block == x), np.flatnonzero(block == y)
        w = v[left] @ v[right].T
        i, j = np.nonzero(w >= threshold)
        w, i, j = w[i, j], left[i], right[j]
        keep = ids[i] != ids[j]
        if x == y:
            keep &= ids[i] < ids[j]
        w, i, j = w[keep], i[keep], j[keep]
        swap = ids[i] > ids[j]
        a, b = np.where(swap, ids[j], ids[i]), np.where(swap, ids[i], ids[j])
        columns = [pa.array(a.tolist(), pa.string()), pa.array(b.tolist(), pa.string()), pa.array(w)]
        if group:
            columns.append(pa.array([table[group][0].as_py()] * len(w), pa.string()))
        return pa.table(columns, names=names)

    schema = "a string, b string, weight double" + (f", {group} string" if group else "")
    return dealt.groupBy("x", "y", *keys).applyInArrow(pairs, schema)
