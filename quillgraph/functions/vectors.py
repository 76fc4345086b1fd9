"""Column expressions and aggregations over vectors held as arrays of doubles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product; the cosine similarity of unit vectors."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` mentions it inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def unit(v: Column | str) -> Column:
    """The vector divided by its length; vectors shorter than 1e-12 stay as they are."""
    v = F.col(v) if isinstance(v, str) else v
    measured = lambda u: F.struct(u.alias("v"), norm(u).alias("n"))
    scaled = lambda s: F.when(s["n"] > 1e-12, F.transform(s["v"], lambda x: x / s["n"])).otherwise(s["v"])
    return bound(bound(v, measured), scaled)


def mean_pool(df: DataFrame, vector: str, weight: str, keys: list[str] | None = None) -> DataFrame:
    """Unit weighted mean by ``keys`` (one row without keys): column ``pooled``.

    A row per dimension and key after the partial aggregation, whatever the number of input rows.
    """
    keys = keys or []
    parts = df.where(F.col(vector).isNotNull()).select(*keys, F.col(weight).alias("_w"), F.posexplode(vector).alias("_i", "_x"))
    means = parts.groupBy(*keys, "_i").agg((F.sum(F.col("_w") * F.col("_x")) / F.sum("_w")).alias("_x"))
    ordered = F.sort_array(F.collect_list(F.struct("_i", "_x")))
    return means.groupBy(*keys).agg(F.transform(ordered, lambda p: p["_x"]).alias("_mean")).select(*keys, unit("_mean").alias("pooled"))
