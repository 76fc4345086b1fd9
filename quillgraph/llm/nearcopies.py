"""Near-duplicate documents by the Jaccard similarity of their sets of five-word shingles, SIMILARITY or more.

Texts of the same words are one class from the start. Classes within RADIUS bits of each other by op7's SimHash, found
by its pivot tables, are candidates (``neardup.links``); they are few of the pairs at 0.8, so more come from minhashes. Of every class, BANDS keys are hashed from ROWS minhashes each;
classes that share a key meet in its bucket. A pair of similarity s meets with chance 1 - (1 - s^ROWS)^BANDS: all but
about 6 in 100,000 pairs at 0.8, and ever fewer above. SimHash alone cannot serve: at 0.8 about ten of its
bits differ and a radius for nearly all such pairs (19) has no bucket that pairs must share.

Every link is verified by the exact similarity of the two sets. First the members of each bucket are compared with its
most central one, which meets most others in its buckets. Buckets whose members then still are in several components
are compared on: the members outside the bucket's largest component with all of them, block by block, a task holding
two blocks of about BLOCK_SHINGLES, without rows for pairs. Links so connect exactly what the verified pairs of all
buckets connect. Nothing gathers a bucket, and no hot key is shuffled whole.

Defined results: those of ``neardup.representatives``; empty, blank and null texts are one class and like no other;
up to five words are one shingle, so such texts are alike only if their words are the same.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import neardup
from quillgraph.llm.common import hot_join, record, slices, texts_of, written
from quillgraph.llm.fingerprints import _mixed, shingle_hashes

SIMILARITY = 0.8
BANDS = 32
ROWS = 6
#: Shingles of a block of sets; pairs that one copy of a central set is compared with.
BLOCK_SHINGLES = 500_000
PAIRS = 2_048
_FACTORS = np.random.default_rng(20241109).integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_SALTS = _mixed(np.arange(1, BANDS + 1, dtype=np.uint64))


def content(text: str) -> int:
    """Texts of the same words, whatever the blanks and the case of A-Z, have the same number; 0 without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    return xxhash.xxh64_intdigest(b" ".join(words), neardup.SEED) if words else 0


def shingle_set(text: str) -> np.ndarray:
    return np.unique(shingle_hashes(text))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One key a band, none for an empty set."""
    if not len(shingles):
        return np.empty(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 512):
        np.minimum(least, (shingles[i : i + 512, None] * _FACTORS).min(0), out=least)
    keys = _SALTS.copy()
    for column in least.reshape(BANDS, ROWS).T:
        keys = _mixed(keys ^ column) + _SALTS
    return keys.view(np.int64)


_SIGNED = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("fp", pa.int64()), ("print", pa.int64()), ("keys", pa.list_(pa.int64()))])
_SETS = pa.schema([("fp", pa.int64()), ("shingles", pa.list_(pa.int64()))])


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, th, fp, print, keys) a document; fp is its class of equal words, print the SimHash that they have in common."""

    def run(batches):
        for batch in slices(batches):
            texts = texts_of(batch)
            yield record(_SIGNED, doc_id=batch.column("doc_id"), th=batch.column("th"), fp=[neardup._signed(content(t)) for t in texts], print=[neardup._signed(neardup.fingerprint(t)) for t in texts], keys=[band_keys(shingle_set(t)) for t in texts])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), "text").mapInArrow(run, "doc_id long, th long, fp long, print long, keys array<long>")


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(fp, shingles) of the classes ``wanted`` (fp, first_id, first_th), from one document each."""

    def run(batches):
        for batch in slices(batches):
            yield record(_SETS, fp=batch.column("fp"), shingles=[shingle_set(t).view(np.int64) for t in texts_of(batch)])

    few = wanted.count() <= neardup.BROADCAST_ROWS
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    own = rows.join(F.broadcast(wanted) if few else wanted, rows["doc_id"].eqNullSafe(wanted["first_id"]) & (rows["th"] == wanted["first_th"]))
    return own.select("fp", "text").mapInArrow(run, "fp long, shingles array<long>").dropDuplicates(["fp"])


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared >= similarity * (len(a) + len(b) - shared)


def block_links(left: pa.Table, right: pa.Table, similarity: float) -> list[tuple[int, int]]:
    """Of two blocks of (fp, component, shingles): links that connect what their alike pairs across components connect."""
    names = [t["fp"].to_numpy() for t in (left, right)]
    parts = [t["component"].to_numpy() for t in (left, right)]
    _, own = np.unique(np.concatenate(parts), return_inverse=True)
    own, other = own[: len(parts[0])], own[len(parts[0]) :]
    sets = [t["shingles"].combine_chunks() for t in (left, right)]
    sizes = [x.value_lengths().to_numpy().astype(np.int64) for x in sets]
    starts = [np.cumsum(n) - n for n in sizes]
    flats = [x.flatten().to_numpy() for x in sets]
    known, at = np.unique(flats[1], return_inverse=True)
    mark, out = np.zeros(len(known), bool), []
    for i, start in enumerate(starts[0].tolist()):
        if (other == own[i]).all():
            continue
        mine = flats[0][start : start + sizes[0][i]]
        spot = np.minimum(np.searchsorted(known, mine), len(known) - 1)
        spot = spot[known[spot] == mine]
        mark[spot] = True
        shared = np.add.reduceat(mark[at], starts[1], dtype=np.int64)
        mark[spot] = False
        for j in np.flatnonzero((shared >= similarity * (sizes[0][i] + sizes[1] - shared)) & (other != own[i])).tolist():
            if own[i] != other[j]:
                out.append((int(names[0][i]), int(names[1][j])))
                gone, stays = int(other[j]), int(own[i])
                own[own == gone] = stays
                other[other == gone] = stays
    return out


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of distinct pairs (a, b), b being few and central: those whose sets are alike. b's set is copied for every PAIRS pairs."""
    counts = written(pairs.groupBy("b").agg(F.count("*").alias("n")), "central")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    copies = F.ceil(F.col("n") / PAIRS).cast("int")
    salted = hot_join(pairs, counts.withColumn("copies", copies), "b", "n", total).select("a", "b", F.pmod(F.xxhash64("a"), F.col("copies")).cast("int").alias("salt"))
    central = counts.join(sets, counts["b"] == sets["fp"]).select("b", F.explode(F.sequence(F.lit(0), copies - 1)).alias("salt"), F.col("shingles").alias("sb"))
    both = salted.join(sets.select(F.col("fp").alias("a"), F.col("shingles").alias("sa")), "a").join(central, ["b", "salt"])
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(shared >= similarity * (F.size("sa") + F.size("sb") - shared)).select("a", "b")


def simhash_pairs(signed: DataFrame) -> DataFrame:
    """(a, b): classes that op7's SimHash links, each print standing for its classes by one of them, b."""
    marked = written(signed.groupBy("fp").agg(F.min("print").alias("print")), "marked")
    heads = written(marked.groupBy("print").agg(F.min("fp").alias("head"), F.count("*").alias("n")), "print-heads")
    total = heads.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    same = hot_join(marked, heads, "print", "n", total).where("fp <> head").select(F.col("fp").alias("a"), F.col("head").alias("b"))
    linked = written(neardup.links(heads.select(F.col("print").alias("fp"))), "print-links")
    end = lambda x: heads.select(F.col("print").alias(x), F.col("head").alias(f"head_{x}"))
    other = linked.join(end("a"), "a").join(end("b"), "b").select(F.col("head_a").alias("a"), F.col("head_b").alias("b"))
    return same.unionByName(other)


def links(docs: DataFrame, signed: DataFrame, similarity: float, classes: DataFrame) -> DataFrame:
    """(a, b): verified pairs that connect the alike classes of ``classes`` (fp, first_id, first_th)."""
    entries = written(signed.select(F.explode("keys").alias("key"), "fp").distinct(), "band-keys")
    shared = written(entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    total = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    inside = written(hot_join(entries, shared.withColumn("size", F.col("n")), "key", "n", total), "members")
    central = inside.groupBy("fp").agg(F.sum("size").alias("rank"))
    ranked = inside.join(central, "fp")
    hubs = written(ranked.groupBy("key").agg(F.max(F.struct("rank", F.col("fp").alias("hub"))).alias("m"), F.count("*").alias("n")).select("key", "m.hub", "n"), "hubs")
    near = written(simhash_pairs(signed), "simhash-pairs")
    wanted = central.select("fp").unionByName(near.select(F.explode(F.array("a", "b")).alias("fp"))).distinct()
    sets = written(shingle_sets(docs, classes.join(wanted, "fp", "left_semi").select("fp", "first_id", "first_th")), "shingles")

    starred = hot_join(inside, hubs, "key", "n", total).where("fp <> hub").select(F.col("fp").alias("a"), F.col("hub").alias("b"))
    pairs = written(starred.unionByName(near).distinct(), "star-pairs")
    first = written(verified(pairs, sets, similarity), "star-links")
    return written(first.unionByName(across(inside, sets, neardup.connected(first), similarity)), "links")


def across(inside: DataFrame, sets: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links between members (key, fp) of a bucket whose components, by ``roots``, differ."""
    sized = sets.select("fp", F.size("shingles").cast("long").alias("weight"))
    placed = inside.join(sized, "fp").join(roots, inside["fp"] == roots["node"], "left").select("key", "fp", "weight", F.coalesce("root", "fp").alias("component"))
    placed = written(placed, "placed")
    parts = written(placed.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"), F.sum(F.xxhash64("fp").cast("decimal(38,0)")).alias("mark")), "parts")
    told = parts.groupBy("key").agg(F.sum("n").alias("n"), F.sum("weight").alias("weight"), F.sum("mark").alias("mark"), F.count("*").alias("parts"), F.max(F.struct("n", "weight", "component")).alias("main"))
    # Buckets with the same members are one.
    split = told.where("parts > 1").groupBy("n", "weight", "mark").agg(F.min(F.struct("key", "main")).alias("k")).select("k.key", "n", "weight", F.col("k.main.component").alias("main"), F.col("k.main.weight").alias("main_weight"))
    blocks = lambda weight: F.ceil(weight / BLOCK_SHINGLES).cast("int")
    split = written(split.select("key", "n", "main", blocks(F.col("weight")).alias("all_blocks"), blocks(F.col("weight") - F.col("main_weight")).alias("few_blocks")), "split")
    total = split.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = hot_join(placed, split, "key", "n", total)
    own = lambda n: F.pmod(F.xxhash64("fp"), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.where("component <> main").select("key", own("few_blocks").alias("i"), upto("all_blocks").alias("j"), F.lit(True).alias("left"), "fp", "component")
    right = rows.select("key", upto("few_blocks").alias("i"), own("all_blocks").alias("j"), F.lit(False).alias("left"), "fp", "component")

    def run(key, table):
        left, right = (table.filter(pc.equal(table["left"], side)) for side in (True, False))
        found = block_links(left, right, similarity) if len(left) and len(right) else []
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return left.unionByName(right).join(sets, "fp").groupBy("key", "i", "j").applyInArrow(run, "a long, b long")


def representatives(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each group of near copies, with all its columns: the smallest doc_id."""
    signed = written(signatures(docs), "signatures")
    return neardup.representatives(docs, signed.select("doc_id", "th", "fp"), partial(links, docs, signed, similarity))
