"""Byte-level BPE by a global shuffle of distinct words.

Pre-tokens ("words") are found in every text and kept with their positions; each distinct word is encoded once; ids
are joined back and reassembled by position. Rows of single words would be many times the corpus, so they travel
aggregated: a block of documents (BLOCK_CHARS characters, or BLOCK_WORDS distinct words) lists its distinct words
once, most frequent first, and its texts as positions in that list. The lists are dealt by a hash of the word, so that
all blocks' copies of a word meet in one bucket, where it is encoded once; the ids go back to the blocks and are
gathered by position. Payloads are compressed arrays. Decoding joins the ids with the token-byte table, whose size is
the vocabulary's.

The blocks are made twice, for the word lists and for the positions, and are named by a hash of their contents, so the
input has to be a stored table that is read in the same order again; ``encoded`` writes other inputs first.

Defined results: a null or empty text has no ids; rows without doc_id and repeated rows are encoded like others; an
empty table gives an empty result; other columns are ignored. Special tokens' strings are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import record, slices, table, written

BLOCK_CHARS = 24_000_000
BLOCK_WORDS = 600_000
#: Buckets of words: one for each BUCKET_CHARS of text, so that a bucket's distinct words hold about so many characters at
#: most, whatever the corpus.
BUCKET_CHARS = 16_000_000
#: Tasks of a stage; buckets and blocks beyond share tasks, one after the other.
MOST_TASKS = 100_000


class Vocabulary:
    """Ranks and pattern of a tiktoken file's contents; built once in each Python worker."""

    _made: dict[tuple[bytes, str], Vocabulary] = {}

    def __init__(self, data: bytes, pattern: str):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}
        self.words = regex.compile(pattern).findall
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.token_bytes = Ragged.of([np.frombuffer(t, np.uint8) for t in tokens], np.uint8)

    @classmethod
    def of(cls, data: bytes, pattern: str) -> Vocabulary:
        if (data, pattern) not in cls._made:
            cls._made[data, pattern] = cls(data, pattern)
        return cls._made[data, pattern]

    def decode(self, ids: np.ndarray) -> bytes:
        return self.token_bytes.gather(ids).tobytes()


@dataclass
class Ragged:
    """Arrays end to end."""

    flat: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, parts: list[np.ndarray], kind) -> Ragged:
        return cls.cut(np.concatenate(parts) if parts else np.empty(0, kind), np.fromiter(map(len, parts), np.int64, len(parts)))

    @classmethod
    def cut(cls, flat: np.ndarray, sizes: np.ndarray) -> Ragged:
        return cls(flat, np.cumsum(sizes) - sizes, sizes)

    def gather(self, at: np.ndarray) -> np.ndarray:
        """The parts with these numbers, end to end."""
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        if not len(ends):
            return self.flat[:0]
        return self.flat[np.repeat(self.starts[at] - ends + sizes, sizes) + np.arange(ends[-1])]


def _squeezed(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays of unsigned integers, or bytes, behind each other; integers by byte planes, which compress better."""
    out = [len(arrays).to_bytes(4, "little")]
    squeeze = zstandard.ZstdCompressor(level=3).compress
    for a in arrays:
        plain = a if isinstance(a, bytes) else np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
        data = squeeze(plain)
        out += [len(data).to_bytes(4, "little"), data]
    return b"".join(out)


def _opened(data: bytes, kinds: str) -> list:
    """``kinds``: i for integers, b for bytes."""
    out, at = [], 4
    for kind in kinds:
        n = int.from_bytes(data[at : at + 4], "little")
        plain = zstandard.ZstdDecompressor().decompress(data[at + 4 : at + 4 + n])
        out.append(plain if kind == "b" else np.ascontiguousarray(np.frombuffer(plain, np.uint8).reshape(4, -1).T).view("<u4").ravel())
        at += 4 + n
    return out


@dataclass
class Block:
    name: int
    words: list[str]
    doc_ids: list[int | None]
    sizes: np.ndarray
    positions: np.ndarray


def blocks(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[Block]:
    """Cut a task's documents into blocks: distinct words by falling count, texts as positions among them."""
    known: dict[str, int] = {}
    doc_ids: list[int | None] = []
    texts: list[np.ndarray] = []
    chars, mark = 0, xxhash.xxh64()

    def done() -> Block:
        flat = np.concatenate(texts)
        order = np.argsort(-np.bincount(flat, minlength=len(known)), kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        words = list(known)
        return Block(mark.intdigest() >> 1, [words[i] for i in order.tolist()], doc_ids, np.fromiter(map(len, texts), np.uint32, len(texts)), rank[flat] if len(flat) else flat)

    for batch in slices(batches):
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            found = vocabulary.words(text or "")
            new = known.setdefault
            texts.append(np.array([new(w, len(known)) for w in found], np.uint32))
            doc_ids.append(doc_id)
            mark.update(f"{doc_id},{len(found)};".encode())
            mark.update((text or "").encode("utf-8", "surrogatepass"))
            chars += len(text or "")
            if chars >= BLOCK_CHARS or len(known) >= BLOCK_WORDS:
                yield done()
                known, doc_ids, texts, chars, mark = {}, [], [], 0, xxhash.xxh64()
    if texts:
        yield done()


_WORDS = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("payload", pa.binary())])
_PARTS = pa.schema([("block", pa.int64()), ("place", pa.int32()), ("payload", pa.binary())])
_CODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
_DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _file(path: str) -> bytes:
    """Read by the driver and sent along: executors need not have the file."""
    with open(path, "rb") as f:
        return f.read()


def _reassembled(docs: DataFrame, path: str, pattern: str, schema: pa.Schema, sql: str, answer) -> DataFrame:
    """``answer(vocabulary, doc_ids, ids)`` makes the rows of some documents from their ids."""
    data = _file(path)
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    chars = rows.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    buckets = int(max(8, -(-chars // BUCKET_CHARS)))

    def word_lists(batches):
        vocabulary = Vocabulary.of(data, pattern)
        for block in blocks(batches, vocabulary):
            dealt: dict[int, list[tuple[bytes, int]]] = {}
            for i, w in enumerate(block.words):
                raw = w.encode("utf-8", "surrogatepass")
                dealt.setdefault(xxhash.xxh32_intdigest(raw) % buckets, []).append((raw, i))
            for own in dealt.values():
                own.sort()
            kept = sorted(dealt)
            yield record(
                _WORDS, bucket=kept, block=[block.name] * len(kept),
                payload=[_squeezed(np.array([i for _, i in dealt[b]], np.uint32), np.array([len(w) for w, _ in dealt[b]], np.uint32), b"".join(w for w, _ in dealt[b])) for b in kept],
            )

    def word_ids(batches):
        vocabulary = Vocabulary.of(data, pattern)
        encode = vocabulary.encoding.encode_ordinary
        kept: dict[bytes, list[int]] = {}
        here = None
        for batch in batches:
            out = []
            for bucket, block, payload in zip(*(batch.column(n).to_pylist() for n in _WORDS.names), strict=True):
                if bucket != here:  # a task's buckets come one after the other
                    here, kept = bucket, {}
                at, sizes, raw = _opened(payload, "iib")
                found, flat, spot = [], [], 0
                for n in sizes.tolist():
                    w = raw[spot : spot + n]
                    spot += n
                    ids = kept.get(w)
                    if ids is None:
                        ids = kept[w] = encode(w.decode("utf-8", "surrogatepass"))
                    found.append(len(ids))
                    flat += ids
                out.append((block, _squeezed(at, np.array(found, np.uint32), np.array(flat, np.uint32))))
            yield record(_PARTS, block=[b for b, _ in out], place=[0] * len(out), payload=[p for _, p in out])

    def positions(batches):
        vocabulary = Vocabulary.of(data, pattern)
        for block in blocks(batches, vocabulary):
            ids = pa.array(block.doc_ids, pa.int64())
            known = np.asarray(ids.is_valid()).astype(np.uint32)
            plain = ids.fill_null(0).to_numpy().view(np.uint64)
            yield record(_PARTS, block=[block.name], place=[1], payload=[_squeezed(block.sizes, block.positions, known, plain & np.uint64(0xFFFFFFFF), plain >> np.uint64(32), np.array([len(block.words)], np.uint32))])

    def joined(batches):
        vocabulary = Vocabulary.of(data, pattern)
        block, parts, ids_of = None, [], None
        for batch in batches:
            for name, place, payload in zip(*(batch.column(n).to_pylist() for n in _PARTS.names), strict=True):
                if name != block:
                    block, parts, ids_of = name, [], None
                if place == 0:
                    parts.append(_opened(payload, "iii"))
                    continue
                sizes, at, known, low, high, n_words = _opened(payload, "iiiiii")
                if ids_of is None:
                    counts = np.zeros(int(n_words[0]), np.int64)
                    for where, n, _ in parts:
                        counts[where] = n
                    if len(parts) and not counts.all() or not len(parts) and len(counts):
                        raise RuntimeError("a block's words did not come back: the input was not read in the same order twice")
                    ids_of = Ragged.cut(np.empty(int(counts.sum()), np.uint32), counts)
                    for where, n, ids in parts:
                        own = Ragged.cut(ids, n.astype(np.int64))
                        ids_of.flat[np.repeat(ids_of.starts[where] - own.starts, own.sizes) + np.arange(len(ids))] = ids
                    parts = []
                doc_ids = (low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32)).view(np.int64)
                ends = np.cumsum(sizes.astype(np.int64))
                for i in range(0, len(sizes), 512):
                    own = range(i, min(i + 512, len(sizes)))
                    ids = [ids_of.gather(at[ends[j] - int(sizes[j]) : ends[j]]) for j in own]
                    yield answer(vocabulary, [int(doc_ids[j]) if known[j] else None for j in own], ids)

    back = rows.mapInArrow(word_lists, "bucket int, block long, payload binary").repartition(min(buckets, MOST_TASKS), "bucket").sortWithinPartitions("bucket").mapInArrow(word_ids, "block long, place int, payload binary")
    parts = rows.mapInArrow(positions, "block long, place int, payload binary").unionByName(back)
    tasks = min(MOST_TASKS, 2 * -(-chars // BLOCK_CHARS))  # two tasks a block, about: most have one or none
    default = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt_ = parts.repartition(int(tasks), "block") if tasks > default else parts.repartition("block")
    return dealt_.sortWithinPartitions("block", "place").mapInArrow(joined, sql)


def encoded(docs: DataFrame, path: str, pattern: str, stored: bool = False) -> DataFrame:
    """(doc_id, ids). ``stored``: docs is a table, read in the same order each time."""
    docs = docs if stored else written(docs.select("doc_id", "text"), "texts")

    def answer(vocabulary, doc_ids, ids):
        return record(_CODED, doc_id=doc_ids, ids=pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))

    return _reassembled(docs, path, pattern, _CODED, "doc_id long, ids array<int>", answer)


def decoded(coded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids): ids joined with the token-byte table; bytes that are no UTF-8 are replaced."""
    data = _file(path)
    out = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        vocabulary = Vocabulary.of(data, pattern)
        for batch in batches:
            yield record(out, doc_id=batch.column("doc_id"), text=[None if x is None else vocabulary.decode(np.array(x, np.int64)).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()])

    return coded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str, pattern: str, stored: bool = False) -> DataFrame:
    """Number and hash of every document's ids, and the hash of the bytes they decode to."""
    docs = docs if stored else written(docs.select("doc_id", "text"), "texts")

    def answer(vocabulary, doc_ids, ids):
        sha = lambda x: hashlib.sha256(x).hexdigest()
        return record(_DIGESTS, doc_id=doc_ids, n_tokens=[len(x) for x in ids], ids_sha256=[sha(x.astype("<u4").tobytes()) for x in ids], decoded_sha256=[sha(vocabulary.decode(x)) for x in ids])

    return _reassembled(docs, path, pattern, _DIGESTS, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", answer)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, stored=True)


QUERIES = {"op9_byte_bpe": op9_byte_bpe}
ORACLES: dict[str, str] = {}
