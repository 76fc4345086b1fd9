"""Incremental operators on Structured Streaming: watches, latest decisions, deduplication, windows.

Streams read files as they land; what they have seen is in the checkpoint, so a run with ``availableNow`` takes up
where the last one ended. A state and its stream's checkpoint lie under one folder: a state opened there again goes on
where it was, in another session too. Each batch writes a whole new version named by the batch's number, and starts from
the latest complete version of an earlier batch, so a batch that runs again gives the same state.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.store import folder, small


class State:
    """A table that each batch of one stream replaces by a new version.

    ``base`` names its folder, shared by driver and executors; without it the state is new and lives for the run.
    The last two versions stay, as readers of the one before may not be done.
    """

    def __init__(self, spark: SparkSession, name: str, empty: DataFrame, base: str | None = None):
        self.spark, self.empty = spark, empty
        self.base = (base or f"{folder(spark)}/quillgraph/state-{name}-{uuid.uuid4().hex}").rstrip("/")

    @property
    def checkpoint(self) -> str:
        """Where the stream that feeds this state keeps its progress."""
        return f"{self.base}/checkpoint"

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/versions")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _versions(self) -> list[tuple[int, str]]:
        """(batch, path) of the complete versions, in order of their batches."""
        fs, path = self._files()
        if not fs.exists(path):
            return []
        found = [str(f.getPath().toString()) for f in fs.listStatus(path)]
        done = [f for f in found if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{f}/_SUCCESS"))]
        return sorted((int(f.rsplit("/", 1)[1].split("-")[0]), f) for f in done)

    def read(self, before: int | None = None) -> DataFrame:
        """The latest version; with ``before``, the latest that a batch of a smaller number wrote."""
        known = [f for n, f in self._versions() if before is None or n < before]
        return self.spark.read.schema(self.empty.schema).parquet(known[-1]) if known else self.empty

    def replace(self, df: DataFrame, number: int) -> None:
        df.write.parquet(f"{self.base}/versions/{number:012d}-{uuid.uuid4().hex}")
        fs, _ = self._files()
        known = self._versions()
        kept = sorted({n for n, _ in known})[-2:]
        for n, f in known:
            if n not in kept:
                fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f), True)


def files(spark: SparkSession, path: str, schema, pattern: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(path)


def run_now(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str | None = None, mode: str = "append") -> None:
    """All that has landed, in batches; returns when it is processed."""
    spot = checkpoint or f"{folder(stream.sparkSession)}/quillgraph/stream-{uuid.uuid4().hex}"
    stream.writeStream.outputMode(mode).option("checkpointLocation", spot).trigger(availableNow=True).foreachBatch(batch).start().awaitTermination()


def latest_by(stream: DataFrame, key: str, order: list[str], state: State) -> DataFrame:
    """The latest row of each key over all batches; re-deciding replaces the older decision."""

    def batch(df: DataFrame, number: int) -> None:
        both = state.read(number).unionByName(df.select(*state.empty.columns))
        rows = F.struct(*[c for c in both.columns if c != key])
        latest = both.groupBy(key).agg(F.max_by(rows, F.struct(*order)).alias("r")).select(key, "r.*")
        state.replace(latest.select(*state.empty.columns), number)

    run_now(stream, batch, state.checkpoint)
    return state.read()


def watch_check(stream: DataFrame, watches: DataFrame, known: DataFrame, state: State, threshold: float) -> DataFrame:
    """Finds of every watch, filed once: rows after the watch's mark, not known, scored above the threshold.

    The mark is the record's creation, not its publication, so what is indexed late still arrives. ``stream`` has
    (token, created, topic, score); ``watches`` (watch, topic, since).
    """

    def batch(df: DataFrame, number: int) -> None:
        hits = df.join(small(watches), "topic").where((F.col("created") >= F.col("since")) & (F.col("score") >= threshold))
        fresh = hits.join(known.select("token"), "token", "left_anti").join(state.read(number).select("token"), "token", "left_anti")
        best = fresh.groupBy("token").agg(F.max_by(F.struct("watch", "score", "created"), F.struct("score", "watch")).alias("r")).select("token", "r.*")
        state.replace(state.read(number).unionByName(best.select(*state.empty.columns)), number)

    run_now(stream, batch, state.checkpoint)
    return state.read()


def windowed_counts(stream: DataFrame, time: str, width: str, lateness: str, keys: list[str], state: State, slide: str | None = None) -> DataFrame:
    """Counts in tumbling windows, or in sliding ones every ``slide``, with a watermark; every window's latest count."""
    counts = stream.withWatermark(time, lateness).groupBy(F.window(time, width, slide), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")

    def batch(df: DataFrame, number: int) -> None:
        old = state.read(number).join(df.select("start", *keys), ["start", *keys], "left_anti")
        state.replace(old.unionByName(df.select(*state.empty.columns)), number)

    run_now(counts, batch, state.checkpoint, mode="update")
    return state.read()


def session_counts(stream: DataFrame, time: str, gap: str, lateness: str, keys: list[str], state: State) -> DataFrame:
    """Counts in sessions that end after a ``gap`` without rows: those the watermark has closed, each once."""
    sessions = stream.withWatermark(time, lateness).groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n"))
    closed = sessions.select(F.col("session_window.start").alias("start"), *keys, "n")
    run_now(closed, lambda df, number: state.replace(state.read(number).unionByName(df.select(*state.empty.columns)), number), state.checkpoint)
    return state.read()


def first_seen(stream: DataFrame, keys: list[str], state: State) -> DataFrame:
    """Each combination of keys once, over all batches: Spark's own deduplication state."""
    run_now(stream.dropDuplicates(keys).select(*keys), lambda df, number: state.replace(state.read(number).unionByName(df), number), state.checkpoint)
    return state.read()
