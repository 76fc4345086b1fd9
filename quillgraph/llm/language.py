"""Language identification by compression.

For each learned language a zstandard raw-content dictionary is cut from a bounded sample of its texts. A text is
lower-cased, reduced to its letters, cut into blocks, and every block is compressed with every dictionary; the
language with the smallest total wins. The margin between the best and the next size, against the best size, says
how sure that is; a text whose margin is narrow is rejected (``accepted`` false), which the pipeline's filter uses.

Defined results: a null text, or one with no letters, is ``und`` with score 0 and not accepted; equal sizes go to the
language with more documents to learn from; with nothing to learn from, every text is ``und``; repeated rows are each reported; other
columns of the input are ignored by ``identify`` and kept by ``accepted``.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import crc_rest, record, slices, table, text_udf, texts_of

UNKNOWN = "und"
#: Bytes of a language's dictionary, and of the blocks compressed against it.
DICTIONARY_BYTES = 64 * 1024
BLOCK_CHARS = 16 * 1024
#: Different texts sampled for each language, about; windows taken from each, and their length.
SAMPLE_DOCS = 100
PIECES = 2
PIECE_CHARS = 400
LEVEL = 9
#: Relative margin under which a text is rejected.
NARROW = 0.02

_NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    """Lower-cased runs of letters, one space between them."""
    return _NOT_LETTERS.sub(" ", text.lower()).strip()


class Compressors:
    """One prepared dictionary a language; made once in each Python worker."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.names = list(dictionaries)
        self.by_language = []
        for name in self.names:
            d = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.by_language.append(zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False))

    def sizes(self, text: str) -> list[int]:
        blocks = [text[i : i + BLOCK_CHARS].encode("utf-8", "replace") for i in range(0, len(text), BLOCK_CHARS)]
        return [sum(len(c.compress(b)) for b in blocks) for c in self.by_language]

    def classify(self, text: str) -> tuple[str, float, float, bool]:
        """Language, score, relative margin, accepted."""
        plain = letters(text)
        if not plain or not self.names:
            return UNKNOWN, 0.0, 0.0, False
        sizes = self.sizes(plain)
        best = min(sizes)
        at = sizes.index(best)
        others = [s for i, s in enumerate(sizes) if i != at]
        if not others:
            return self.names[at], 1.0, 1.0, True
        margin = (min(others) - best) / best
        score = 1 / (1 + sum(math.exp(-min(50.0, (s - best) / 4)) for s in others))
        return self.names[at], score, margin, margin >= NARROW


def pieces(text: Column) -> Column:
    """PIECES windows of PIECE_CHARS, spread evenly over the whole text; a shorter text whole."""
    room = F.length(text) - PIECE_CHARS
    windows = [F.substring(text, (F.floor(room * i / (PIECES - 1)) + 1).cast("int"), F.lit(PIECE_CHARS)) for i in range(PIECES)]
    return F.when(F.length(text) <= PIECES * PIECE_CHARS, text).otherwise(F.concat_ws(" ", *windows))


def dictionary(texts: list[str]) -> bytes:
    """The texts' letters one after the other, of each an equal share of DICTIONARY_BYTES and what shorter ones leave over."""
    parts = sorted((letters(t).encode() for t in texts), key=len)
    out, room = [], DICTIONARY_BYTES
    for i, part in enumerate(parts):
        share = max(0, room // (len(parts) - i) - 1)
        out.append(part[:share])
        room -= len(out[-1]) + 1
    return b" ".join(x for x in out if x)


def fit(labelled: DataFrame) -> dict[str, bytes]:
    """Dictionaries from a bounded sample of (text, lang): about SAMPLE_DOCS different texts a language, by a hash of the text.

    The first pass counts each language's documents and (about) its different texts; the second keeps those whose hash falls
    under the language's rate, all of them where there are few: no language is left without texts, however often they repeat.
    Of each sampled text go PIECES windows to the driver.
    """
    known = labelled.where("lang is not null and text is not null and length(text) > 0").select("lang", "text", F.xxhash64("text").alias("h"))
    counts = {r.lang: (r.n, r.distinct) for r in known.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("h").alias("distinct")).collect()}
    if not counts:
        return {}
    rate = F.coalesce(*[F.when(F.col("lang") == name, F.lit(min(1.0, SAMPLE_DOCS / distinct if distinct > 2 * SAMPLE_DOCS else 1.0))) for name, (_, distinct) in sorted(counts.items())])
    chance = F.pmod("h", F.lit(1 << 30)) / float(1 << 30)
    picked = known.where(chance < rate).groupBy("lang", "h").agg(F.min(pieces(F.col("text"))).alias("text"))
    parts: dict[str, list[str]] = {}
    for r in picked.orderBy("lang", "h").limit(4 * SAMPLE_DOCS * len(counts)).collect():
        parts.setdefault(r.lang, []).append(r.text)
    order = sorted(parts, key=lambda name: (-counts[name][0], name))
    made = {name: dictionary(parts[name]) for name in order}
    return {name: d for name, d in made.items() if d}


def held_in(docs: DataFrame) -> DataFrame:
    """The rows whose languages may be learned."""
    return docs.where((crc_rest("doc_id", 4) != 2) & F.col("lang").isNotNull())


_OUT = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("margin", pa.float64()), ("accepted", pa.bool_())])


def identify(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """One row a document, from its text alone."""

    def run(batches):
        compressors = Compressors(dictionaries)
        for batch in slices(batches):
            got = [compressors.classify(t) for t in texts_of(batch)]
            yield record(_OUT, doc_id=batch.column("doc_id"), **{n: [g[i] for g in got] for i, n in enumerate(_OUT.names[1:])})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, margin double, accepted boolean")


def accepted(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """The documents that are not rejected, with their columns as they were."""
    made: list[Compressors] = []

    def keep(texts):
        if not made:
            made.append(Compressors(dictionaries))
        return [made[0].classify(t or "")[3] for t in texts]

    return docs.where(text_udf(keep, "boolean", pa.bool_())("text"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit(held_in(docs)))
    return found.withColumn("held_out", F.coalesce(crc_rest("doc_id", 4) == 2, F.lit(False)))


QUERIES = {"op2_language_id": op2_language_id}
ORACLES: dict[str, str] = {}
