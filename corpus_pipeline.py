"""A training corpus from ``documents``: filter, identify, deduplicate, redact, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written and read again before the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm import language, nearcopies, packing, pii, quality
from quillgraph.llm.common import table, written


#: Documents in an Arrow batch. Whole texts are long rows: this bounds what the JVM and its Python workers hold for a task.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the rows it may learn from, does not reject."""
    small_batches(spark)
    model = quality.fit(quality.held_in(docs), quality.held_in(table(spark, sf_dir, "labels")))
    return quality.accepted(docs, model)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a sufficient margin."""
    small_batches(spark)
    return language.accepted(docs, language.fit(language.held_in(docs)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near-duplicates (op7's SimHash and minhashes, verified: five-word shingles, similarity 0.8): the one with the smallest doc_id."""
    small_batches(spark)
    return nearcopies.representatives(docs)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every found span of personal data replaced by its kind."""
    small_batches(spark)
    return pii.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, measured in tokens, in training sequences of several permitted lengths."""
    small_batches(spark)
    return packing.packed(docs, packing.public_measure())


STAGES = [
    ("quality", keep_quality),
    ("language", keep_languages),
    ("neardup", drop_near_copies),
    ("pii", redact_pii),
    ("packing", pack),
]

#: The stages learn models; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
