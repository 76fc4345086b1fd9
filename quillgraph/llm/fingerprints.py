"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every distinct shingle hash below 2^64 / SCALE, so its size follows the text, sketches of any sizes
merge by union, and containment of a short text in a very long one can be estimated. Nothing else is kept or topped up:
a text of a few shingles may have an empty sketch.

Shingles are five words (runs between ASCII blanks, A-Z in lower case); fewer words are one shingle.

``beside_next`` compares every document with an edited copy of itself and with the next document by descending
doc_id. One shuffle deals whole texts into ranges of doc_id; the first row of each range is dealt to the range before
it as well, so that neighbours meet, and rows stream through in order with one row kept back. Many rows of one doc_id,
or of none, are a range that is split further by the hash of their texts.

Defined results: a null or empty text has an empty sketch; two empty sketches are alike to 1 if the texts are equal and
to 0 otherwise, an empty and another one to 0; rows without doc_id come last, equal doc_ids are ordered by their texts; the last row's next is the first;
a single row is its own next; repeated rows are each reported; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import record, slices, table

SHINGLE = 5
SCALE = 4
THRESHOLD = np.uint64((1 << 64) // SCALE)
#: Rows of a range of doc_id, about, and the most ranges (parallelism only: a range is streamed).
RANGE_ROWS = 2_000
MAX_RANGES = 20_000

_WORDS: dict[bytes, int] = {}
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _ODD[1]
    h = (h ^ (h >> np.uint64(27))) * _ODD[2]
    return h ^ (h >> np.uint64(31))


def shingle_hashes(text: str) -> np.ndarray:
    """A hash for each shingle, repeats included."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(_WORDS) > 200_000:
        _WORDS.clear()
    known, hashes = _WORDS.get, []
    for w in words:
        h = known(w)
        if h is None:
            h = _WORDS[w] = xxhash.xxh64_intdigest(w)
        hashes.append(h)
    h = np.array(hashes, np.uint64)
    k = min(SHINGLE, len(h))
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = (out ^ h[i : len(h) - k + 1 + i]) * _ODD[0] + _ODD[3]
    return _mixed(out)


def sketch(text: str) -> np.ndarray:
    h = shingle_hashes(text)
    return np.unique(h[h < THRESHOLD])


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of both texts' shingles together."""
    return np.union1d(a, b)


def compare(a: np.ndarray, b: np.ndarray, equal: bool = False) -> tuple[float, float, float]:
    """Estimates of Jaccard likeness, of the share of a's shingles in b, and of b's in a; ``equal`` decides on empty sketches."""
    if not len(a) and not len(b):
        return float(equal), float(equal), float(equal)
    common = len(np.intersect1d(a, b, assume_unique=True))
    either = len(a) + len(b) - common
    return (common / either if either else 0.0, common / len(a) if len(a) else 0.0, common / len(b) if len(b) else 0.0)


def rendered(s: np.ndarray) -> str:
    """Sixteen hex digits a hash, ascending."""
    return s.astype(">u8").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many of the next text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


_SKETCHES = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.list_(pa.int64()))])


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint as ascending unsigned hashes in signed longs), without any shuffle."""

    def run(batches):
        for batch in slices(batches):
            got = [sketch(t or "").view(np.int64) for t in batch.column("text").to_pylist()]
            yield record(_SKETCHES, doc_id=batch.column("doc_id"), fingerprint=pa.array(got, pa.list_(pa.int64())))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fingerprint array<long>")


_OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string())]
    + [(n, pa.float64()) for n in ("near_edited", "near_next", "kept_in_edited", "contained_in_next")]
)


def _neighbours(batches):
    """Rows by range, borrowed last, in order: each own row is answered when the row after it is known."""
    held = None
    for batch in slices(batches):
        out = []
        for at, borrowed, doc_id, text in zip(*(batch.column(n).to_pylist() for n in ("at", "borrowed", "doc_id", "text")), strict=True):
            text = text or ""
            if borrowed and (held is None or held[0] != at):
                continue  # further rows of the borrowed doc_id
            mine = sketch(text)
            if held is not None and held[0] == at:
                _, before_id, before, print_ = held
                changed = edited(before, text)
                print_changed = sketch(changed)
                near = compare(print_, print_changed, before == changed)
                near_next = compare(print_, mine, before == text)
                out.append((before_id, len(before), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), rendered(print_), rendered(print_changed), near[0], near_next[0], near[1], near_next[1]))
            held = None if borrowed else (at, doc_id, text, mine)
        yield record(_OUT, **{n: [r[i] for r in out] for i, n in enumerate(_OUT.names)})
    if held is not None:
        raise RuntimeError("a range ends without its borrowed row")


def beside_next(docs: DataFrame) -> DataFrame:
    """One row a document: its sketch, that of the edited text, and the likeness to that and to the next document's."""
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    ids = rows.select("doc_id")
    n = ids.count()
    ranges = max(1, min(MAX_RANGES, -(-n // RANGE_ROWS)))
    cuts = sorted(set(ids.where("doc_id is not null").approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.2 / ranges) if ranges > 1 else []))
    # Ranges count upwards with falling doc_id; rows without one come after all others.
    spots = F.array(*[F.lit(int(c)) for c in cuts]) if cuts else None
    at = F.lit(0) if spots is None else F.size(spots) - F.size(F.filter(spots, lambda c: c < F.col("doc_id")))
    if spots is not None and len(cuts) > 200:
        steps = np.array([int(c) for c in cuts], np.int64)

        @F.pandas_udf("int")
        def range_of(ids):
            import pandas as pd

            return pd.Series(len(steps) - np.searchsorted(steps, ids.fillna(0).to_numpy(np.int64), "left"), dtype="int32")

        at = range_of("doc_id")
    last = len(cuts) + 1
    placed = lambda df: df.withColumn("at", F.when(F.col("doc_id").isNull(), F.lit(last)).otherwise(at).cast("int"))
    told = {r["at"]: r for r in placed(ids).groupBy("at").agg(F.max("doc_id").alias("head"), F.min("doc_id").alias("tail"), F.count("*").alias("n")).collect()}
    # Ranges that hold one doc_id only, or none, are split by the hash of the text, in which order their rows come.
    parts = {k: min(MAX_RANGES, -(-r.n // RANGE_ROWS)) for k, r in told.items() if r["head"] == r["tail"] and (r["head"] is None or r.n > 4 * RANGE_ROWS)}
    h = F.xxhash64("text")
    share = h.cast("double") / float(1 << 64) + 0.5
    part = F.coalesce(*[F.when(F.col("at") == k, F.least(F.lit(m - 1), F.floor(share * m))) for k, m in sorted(parts.items())], F.lit(0)).cast("long")
    dealt = lambda df: placed(df).withColumn("at", (F.col("at").cast("long") * (1 << 20) + part if parts else F.col("at").cast("long") * (1 << 20)))
    heads = {(k << 20): (r["head"], None) for k, r in told.items() if k not in parts}
    for r in dealt(placed(rows).where(F.col("at").isin(list(parts))).drop("at")).groupBy("at").agg(F.max("doc_id").alias("head"), F.min(h).alias("h")).collect() if parts else ():
        heads[r["at"]] = (r["head"], r["h"])
    order = sorted(heads)
    # The head row of each range goes to the range before it too, the first one's to the last.
    pairs = [(*heads[k], order[i - 1]) for i, k in enumerate(order)]
    borrowed_by = docs.sparkSession.createDataFrame(pairs, "head long, head_h long, borrower long")
    own = dealt(rows).withColumn("borrowed", F.lit(False))
    # Ranges number MAX_RANGES and the rows of their splits: so do these rows.
    is_head = rows["doc_id"].eqNullSafe(borrowed_by["head"]) & F.coalesce(borrowed_by["head_h"] == F.xxhash64(rows["text"]), F.lit(True))
    lent = rows.join(F.broadcast(borrowed_by), is_head).select("doc_id", "text", F.col("borrower").alias("at"), F.lit(True).alias("borrowed"))
    both = own.unionByName(lent).repartition("at").sortWithinPartitions("at", "borrowed", F.desc_nulls_last("doc_id"), F.xxhash64("text"), "text")
    return both.select("at", "borrowed", "doc_id", "text").mapInArrow(_neighbours, ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'double' if f.type == pa.float64() else 'string'}" for f in _OUT))


def op6_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return beside_next(table(spark, sf_dir, "documents"))


QUERIES = {"op6_scaled_sketch": op6_scaled_sketch}
ORACLES: dict[str, str] = {}
