"""A deterministic stand-in for an embedding model, and pooling of texts longer than a model's window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.text import chunks
from quillgraph.functions.vectors import bound, mean_pool, unit

DIMENSION = 384
CHUNK_WORDS, CHUNK_OVERLAP, MOST_CHUNKS = 300, 60, 8


def hash_embedding(text: Column, dimension: int = DIMENSION) -> Column:
    """The SHA-256 digest's bytes, repeated to the dimension, as a unit vector: equal texts get equal vectors."""
    digest = F.sha2(F.encode(text, "UTF-8"), 256)
    octets = bound(digest, lambda d: F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.conv(F.substring(d, 2 * i + 1, F.lit(2)), 16, 10).cast("double")))
    return unit(F.slice(F.flatten(F.array_repeat(octets, -(-dimension // 32))), 1, dimension))


def pooled_texts(texts: DataFrame, key: str, text: str, embed=hash_embedding) -> DataFrame:
    """(key, n_chunks, pooled): unit mean over the first chunks of each text; a text too short for a chunk is embedded whole."""
    cut = F.slice(chunks(F.col(text), CHUNK_WORDS, CHUNK_OVERLAP), 1, MOST_CHUNKS)
    parts = texts.select(key, F.explode(F.when(F.size(cut) > 0, cut).otherwise(F.array(F.col(text)))).alias("_part"))
    vectors = parts.select(key, embed(F.col("_part")).alias("_v"), F.lit(1.0).alias("_w"))
    counts = parts.groupBy(key).agg(F.count("*").alias("n_chunks"))
    return counts.join(mean_pool(vectors, "_v", "_w", [key]), key)


def best_text(full: Column, abstract: Column, title: Column) -> Column:
    """What a paper is embedded by: its full text, else its abstract, else its title."""
    known = lambda c: F.when(F.trim(c) != "", c)
    return F.coalesce(known(full), known(abstract), title)
