"""Variable-capacity best-fit packing.

Documents are measured in tokens of a byte-level BPE vocabulary, by ``tokens_of``, or by another given measure, such as
``words_in``; one longer than the largest permitted length is cut into pieces, none of which is lost. Pieces are dealt
evenly into shards of about SHARD_PIECES, and each shard is packed by best-fit decreasing: a piece goes to the open bin that it leaves least room in; where none has room, a bin is opened
whose size has the least cost for each word it can be expected to hold, given what is still to come; in the end every
bin is downsized to the smallest permitted length that holds its contents. A bin costs OVERHEAD + size +
ATTENTION * size^2.

Defined results: a null or empty text is one piece of length 0 in no bin; equal lengths are taken by doc_id (none
first), hash of the text, and piece, so the result does not depend on the order of rows; rows without doc_id and repeated
rows are packed like others, rows of the same doc_id and text being counted first and dealt singly; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import record, slices, table, texts_of, written
from quillgraph.llm.tokenizer import Vocabulary

LENGTHS = (256, 512, 1024, 2048, 4096)
OVERHEAD = 16.0
ATTENTION = 1 / 65536
SHARD_PIECES = 20_000


def cost(size: int) -> float:
    return OVERHEAD + size + ATTENTION * size * size


def pack(pieces: Sequence[int], lengths: Sequence[int] = LENGTHS) -> tuple[list[int], list[int], list[int]]:
    """For pieces sorted by falling length, all from 1 to the largest permitted one: each one's bin and offset; each bin's size."""
    lengths = sorted(lengths)
    costs = {s: cost(s) for s in lengths}
    top = lengths[-1]
    room: list[list[int]] = [[] for _ in range(top + 1)]  # open bins by room left
    some = 0  # bit r: room[r] has bins
    capacity: list[int] = []
    used: list[int] = []
    bins, offsets = [], []
    left = sum(pieces)
    for n in pieces:
        left -= n
        fitting = some >> n
        if fitting:
            r = n + ((fitting & -fitting).bit_length() - 1)
            at = room[r].pop()
            if not room[r]:
                some &= ~(1 << r)
        else:
            # Later pieces are no longer than this one and may fill what is left of the bin.
            size = min((s for s in lengths if s >= n), key=lambda s: costs[s] / min(s, n + left))
            at, r = len(capacity), size
            capacity.append(size)
            used.append(0)
        bins.append(at)
        offsets.append(used[at])
        used[at] += n
        r -= n
        if r:
            room[r].append(at)
            some |= 1 << r
    sizes = [next(s for s in lengths if s >= u) for u in used]
    return bins, offsets, sizes


_LENGTHS = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n", pa.int64())])


def words_in(text: str) -> int:
    """Runs between blanks."""
    return len(text.split())


def tokens_of(path: str, pattern: str) -> Callable[[str], int]:
    """A measure: tokens of the vocabulary at ``path``, which the driver reads and sends along."""
    with open(path, "rb") as f:
        data = f.read()
    made: list[Vocabulary] = []  # a task's own copy of this closure looks its worker's vocabulary up once

    def tokens(text: str) -> int:
        if not made:
            made.append(Vocabulary.of(data, pattern))
        return len(made[0].encoding.encode_ordinary(text))

    return tokens


def measured(docs: DataFrame, measure: Callable[[str], int]) -> DataFrame:
    """(doc_id, th, n) a document; th is a hash of its text."""

    def run(batches):
        for batch in slices(batches):
            yield record(_LENGTHS, doc_id=batch.column("doc_id"), th=batch.column("th"), n=[measure(t) if t else 0 for t in texts_of(batch)])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), "text").mapInArrow(run, "doc_id long, th long, n long")


_PACKED = "doc_id long, piece int, piece_start long, length int, bin_id long, capacity int, bin_offset int"


def packed(docs: DataFrame, measure: Callable[[str], int] = words_in, lengths: Sequence[int] = LENGTHS) -> DataFrame:
    """One row a piece: where it starts in its document and its length, by ``measure``, its bin, the bin's size, its offset there."""
    top = max(lengths)
    rows = measured(docs, measure).groupBy("doc_id", "th", "n").agg(F.count("*").alias("copies"))
    keyed = written(rows, "lengths")
    each = F.greatest(F.lit(1), F.ceil(F.col("n") / top))
    total = keyed.agg(F.sum(F.col("copies") * each)).first()[0] or 0
    shards = max(1, -(-int(total) // SHARD_PIECES))
    single = keyed.select("doc_id", "th", "n", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    piece = F.explode(F.sequence(F.lit(0), (each - 1).cast("int"))).alias("piece")
    start = F.col("piece").cast("long") * top
    pieces = single.select("doc_id", "th", "copy", "n", piece).select("doc_id", "th", "copy", "piece", start.alias("piece_start"), F.least(F.lit(top), F.col("n") - start).cast("int").alias("length"))
    empty = pieces.where("length <= 0").select("doc_id", "piece", "piece_start", "length", F.lit(None).cast("long").alias("bin_id"), F.lit(None).cast("int").alias("capacity"), F.lit(None).cast("int").alias("bin_offset"))

    def shard(rows: pa.Table) -> pa.Table:
        by = [("length", "descending"), *((n, "ascending") for n in ("doc_id", "th", "copy", "piece"))]
        rows = rows.take(pc.sort_indices(rows, by, null_placement="at_start"))
        bins, offsets, sizes = pack(rows["length"].to_pylist(), lengths)
        base = rows["shard"][0].as_py() << 24
        return pa.table(
            {n: rows[n] for n in ("doc_id", "piece", "piece_start", "length")}
            | {"bin_id": pa.array([base + b for b in bins], pa.int64()), "capacity": pa.array([sizes[b] for b in bins], pa.int32()), "bin_offset": pa.array(offsets, pa.int32())}
        )

    dealt = pieces.where("length > 0").withColumn("shard", F.pmod(F.xxhash64("doc_id", "th", "copy", "piece"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(shard, _PACKED).unionByName(empty)


def public_measure() -> Callable[[str], int]:
    """Tokens of the public vocabulary that op9 uses."""
    import public_tokenizers

    return tokens_of(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), public_measure())


QUERIES = {"op10_bestfit_packing": op10_bestfit_packing}
ORACLES: dict[str, str] = {}
