"""Append-only logs: audit events, metric series, experiment tables, inboxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

AUDIT = "ts double, event string, paper_id string, doi string, title string, decision string, rating double, n_results long, new_unique long, n_new long, sources map<string, long>"
COUNTERS = ("_papers", "_clusters", "_edges", "_levels", "_events")
LABELS = ("timestamp_iso", "snapshot_file")


def read_events(spark: SparkSession, path: str, event: str | None = None) -> DataFrame:
    """Audit lines, oldest first; blank and corrupt lines are left out."""
    df = spark.read.schema(f"{AUDIT}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    df = df.where("_corrupt is null and event is not null").drop("_corrupt")
    return (df if event is None else df.where(F.col("event") == event)).orderBy("ts")


def log_event(spark: SparkSession, path: str, ts: float, event: str, **fields) -> None:
    known = T._parse_datatype_string(AUDIT)
    spark.createDataFrame([tuple(({"ts": ts, "event": event} | fields).get(f.name) for f in known)], known).coalesce(1).write.mode("append").json(path)


def read_metrics(spark: SparkSession, path: str, schema: str, last: int | None = None) -> DataFrame:
    """Metric rows by time; missing counters are 0, labels empty, other numbers NaN; the last rows only, if asked."""
    df = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    fill = lambda f: "" if f.name in LABELS else 0 if f.name.endswith(COUNTERS) else float("nan")
    df = df.select(*[F.coalesce(f.name, F.lit(fill(f)).cast(f.dataType)).alias(f.name) for f in df.schema])
    return df.orderBy("timestamp_iso") if last is None else df.orderBy(F.desc("timestamp_iso")).limit(last).orderBy("timestamp_iso")


def compacted(log: DataFrame, snapshots: DataFrame, key: str = "snapshot_file") -> DataFrame:
    """The log with the snapshots that it does not hold yet; doing it again changes nothing."""
    return log.unionByName(snapshots.join(log.select(key), key, "left_anti").dropDuplicates([key]))


def read_experiments(spark: SparkSession, path: str, last: int) -> DataFrame:
    """The last rows of a tab-separated log by its round column."""
    df = spark.read.option("sep", "\t").option("header", True).schema("round int, parameter string, value double, train double, validation double, kept boolean").csv(path)
    return df.orderBy(F.desc("round")).limit(last)


def inbox_added(inbox: DataFrame, found: DataFrame, known: DataFrame) -> DataFrame:
    """The inbox with finds whose token is neither in it nor in the graph; of equal tokens the best score comes in."""
    new = found.join(inbox.select("token"), "token", "left_anti").join(known.select(F.col("paper_id").alias("token")), "token", "left_anti")
    best = new.groupBy("token").agg(F.max_by(F.struct(*[c for c in new.columns if c != "token"]), F.struct("score", "watch")).alias("r")).select("token", "r.*")
    return inbox.unionByName(best.select(*inbox.columns))


def inbox_without(inbox: DataFrame, tokens: DataFrame) -> DataFrame:
    return inbox.join(tokens.select("token"), "token", "left_anti")
