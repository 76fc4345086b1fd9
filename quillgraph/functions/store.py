"""Tables written to the shared folder between the rounds of iterative operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where that is unset, a temporary one, in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no folder that the executors share")
    if not _OWN:
        own = tempfile.TemporaryDirectory(prefix="quillgraph-")
        atexit.register(own.cleanup)
        _OWN.append(f"file://{own.name}")
    return _OWN[0]


#: Spark's switch for the shuffle files of a query that has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries that run inside go as each ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def settled(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read from a written table: the lineage ends here, and its shuffle files with it."""
    path = f"{folder(df.sparkSession)}/quillgraph/{name}-{uuid.uuid4().hex}"
    with passing(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows up to which a side of a join is broadcast; counted first, beyond it Spark joins by a shuffle.
SMALL_ROWS = 100_000


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
