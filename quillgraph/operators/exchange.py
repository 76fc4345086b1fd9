"""Exchange between corpora: reconciliation of a received capsule, archives with a manifest of hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.store import settled

#: Papers of the own corpus in a block that received papers are compared with.
BLOCK_ROWS = 4_096


def best_similarity(received: DataFrame, own: DataFrame) -> DataFrame:
    """(paper_id, best): the highest cosine with any own paper; blocks of own papers pass by every received block."""
    n = own.count()
    m = received.count()
    blocks, groups = max(1, -(-n // BLOCK_ROWS)), max(1, -(-m // BLOCK_ROWS))
    spread = lambda df, k, name: df.withColumn(name, F.pmod(F.xxhash64("paper_id"), F.lit(k)).cast("int"))
    left = spread(received.select("paper_id", "embedding"), groups, "g").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = spread(own.select("paper_id", F.col("embedding").alias("v")), blocks, "y").select("y", "v", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("x"))

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"paper_id": pa.array([], pa.string()), "best": pa.array([], pa.float64())})
        x, y = np.array(a["embedding"].to_pylist(), float), np.array(b["v"].to_pylist(), float)
        return pa.table({"paper_id": a["paper_id"].cast(pa.string()), "best": (x @ y.T).max(axis=1)})

    found = left.groupBy("b", "g").cogroup(right.groupBy("y", "x")).applyInArrow(compare, "paper_id string, best double")
    return found.groupBy("paper_id").agg(F.max("best").alias("best"))


def reconcile(received: DataFrame, own: DataFrame, threshold: float = 0.92) -> DataFrame:
    """(paper_id, class, best): shared by DOI, imported (identified and titled), shared by embedding, or novel."""
    known = own.where("doi <> ''").select(F.lower("doi").alias("_d")).distinct().withColumn("_known", F.lit(True))
    df = received.join(known, F.lower("doi") == F.col("_d"), "left").join(best_similarity(received, own), "paper_id", "left")
    kind = F.when((F.col("doi") != "") & F.col("_known"), "shared_by_doi").when((F.col("doi") != "") & (F.col("title") != ""), "imported").when(F.col("best") >= threshold, "shared_by_embedding").otherwise("novel")
    return df.select("paper_id", kind.alias("class"), "best")


def export_archive(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Write each table as JSON lines under ``path``; then, last, a manifest (name, rows, digest), which is returned.

    The digest is order-free: the sum of 64-bit hashes of all rows.
    """
    spark = next(iter(tables.values())).sparkSession
    facts = []
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")
        facts.append((name, *_digest(spark.read.schema(df.schema).json(f"{path}/{name}"))))
    manifest = spark.createDataFrame(facts, "name string, rows long, digest string")
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return manifest


def _digest(df: DataFrame) -> tuple[int, str]:
    h = F.xxhash64(F.to_json(F.struct(*sorted(df.columns))))
    n, s = df.agg(F.count("*"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string")).first()
    return n, s


def import_archive(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """The archive's tables after their digests were checked; fields that the schemas do not name are ignored. Edges whose ends are no papers go."""
    listed = {r.name: (r.rows, r.digest) for r in spark.read.schema("name string, rows long, digest string").json(f"{path}/manifest").collect()}
    out = {}
    for name, schema in schemas.items():
        df = spark.read.schema(schema).json(f"{path}/{name}")
        if listed.get(name) != _digest(df):
            raise ValueError(f"{name} is not what the manifest says")
        out[name] = df
    if "edges" in out and "papers" in out:
        ids = out["papers"].select("paper_id")
        for end in ("src", "dst"):
            out["edges"] = out["edges"].join(ids.select(F.col("paper_id").alias(end)), end, "left_semi")
    return out


def validate_capsule(nodes: DataFrame, edges: DataFrame, dim: int) -> list[str]:
    """What is wrong with a received capsule (idx, embedding) and its (src, dst) edges; empty when it is sound."""
    n = nodes.count()
    wrong = []
    if nodes.select("idx").distinct().count() != n or nodes.where((F.col("idx") < 0) | (F.col("idx") >= n)).limit(1).count():
        wrong.append("node numbers are not 0 to n - 1")
    if nodes.where(F.col("embedding").isNull() | (F.size("embedding") != dim) | F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).limit(1).count():
        wrong.append("vectors of a wrong size or with non-finite components")
    if edges.where(~F.col("src").between(0, n - 1) | ~F.col("dst").between(0, n - 1)).limit(1).count():
        wrong.append("edges to nodes that do not exist")
    return wrong


def save_guarded(edges: DataFrame, path: str) -> bool:
    """Overwrite the stored edges unless there would be fewer than before; the new ones then go beside them."""
    spark = edges.sparkSession
    new = settled(edges, "state")
    try:
        before = spark.read.parquet(f"{path}/current").count()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        before = 0
    fine = new.count() >= before
    new.write.mode("overwrite").parquet(f"{path}/{'current' if fine else 'rejected'}")
    return fine
