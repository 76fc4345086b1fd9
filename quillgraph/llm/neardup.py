"""Near-duplicate documents by SimHash and pivot distance tables.

Every text gets a 64-bit fingerprint: word 3-shingles hashed by XXH64 (seed 42), a bit set where over half of the
hashes have it. Documents with equal fingerprints are one class from the start, so everything after works on distinct
fingerprints. A pivot table holds, for each fingerprint, its Hamming distances to PIVOTS fixed reference
fingerprints; by the triangle inequality a pair whose coordinates differ by more than RADIUS anywhere cannot link,
and is discarded; what is left is verified by its own Hamming distance.

So that no pass over all pairs is needed, pairs are formed only inside buckets: the 64 bits are cut into six blocks,
and two fingerprints that differ in at most three bits agree on at least three blocks, so they meet in one of the
twenty three-block buckets. A pair is looked at in the first bucket where it meets only. A bucket of more than DENSE
fingerprints does not list its pairs: it is split further, exactly, by blocks of the bits that vary inside it, and
yields a spanning star of each of its connected parts. Buckets of more than MOST fingerprints are split in the same way
before any task holds one (``dealt``). The links' connected components come from alternating large-star and small-star
rounds, each written to the shared folder. Joins on fingerprints, hubs and components broadcast the keys that hold
a noticeable share of the rows (``common.hot_join``), so that a group of copies, whatever its size, fills no task.

Defined results: a null, empty or blank text has fingerprint zero, linked like any other; ties need no breaking, as a
component is named by its smallest doc_id; rows without doc_id get their component's smallest doc_id, null where it
has none; repeated rows are each reported by ``components`` and one of them stays in ``representatives``, which finds the
duplicates and drops them; an empty
table gives an empty result; other columns are ignored or kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import discard, hot_join, record, slices, table, texts_of, written

RADIUS = 3
SHINGLE = 3
SEED = 42
PIVOTS = np.random.default_rng(20240607).integers(0, 1 << 64, 24, dtype=np.uint64)
#: Buckets up to this size are checked pair by pair.
DENSE = 256
#: Buckets beyond about this size are split before they are dealt to tasks; found by a sample of fingerprints, by hash.
MOST = 65_536
SAMPLED = 64
#: Marks the parts of split buckets: their pairs count wherever they meet.
_SPLIT = 99
#: Rows of which a broadcast is allowed: two longs each. Beyond, the documents are joined by a shuffle.
BROADCAST_ROWS = 200_000

_EDGES_AT = (0, 11, 22, 33, 44, 54, 64)
_BLOCKS = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(_EDGES_AT, _EDGES_AT[1:], strict=False)]
_COMBOS = list(combinations(range(6), 3))
_MASKS = [_BLOCKS[a] | _BLOCKS[b] | _BLOCKS[c] for a, b, c in _COMBOS]


def _first_combo_table() -> np.ndarray:
    """By the set of blocks on which a pair agrees: the first combination inside it."""
    out = np.full(64, 99, np.uint8)
    for same in range(64):
        for i, c in enumerate(_COMBOS):
            if all(same >> b & 1 for b in c):
                out[same] = i
                break
    return out


_FIRST = _first_combo_table()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str) -> int:
    """Only A-Z change case; the words are the runs between ASCII blanks, so bytes serve."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[: len(words) - SHINGLE + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist(), strict=True)], np.uint64)
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        total += np.unpackbits(hashes[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view(np.uint64)[0])


_PRINTS = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("fp", pa.int64())])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, th, fp) a document; fp is the fingerprint as a signed long, th a hash that tells rows of one doc_id apart."""

    def run(batches):
        for batch in slices(batches):
            yield record(_PRINTS, doc_id=batch.column("doc_id"), th=batch.column("th"), fp=[_signed(fingerprint(t)) for t in texts_of(batch)])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), "text").mapInArrow(run, "doc_id long, th long, fp long")


def pivot_table(prints: np.ndarray) -> np.ndarray:
    """Hamming distances to every pivot, one row a fingerprint."""
    return np.stack([np.bitwise_count(prints ^ p) for p in PIVOTS], axis=1).astype(np.int8)


def _surviving(prints: np.ndarray, table_: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the pairs (a, b): those that no pivot discards and whose own distance is small enough."""
    near = np.ones(len(a), bool)
    for i in range(0, table_.shape[1], 8):  # most pairs go after a few coordinates
        at = np.flatnonzero(near)
        near[at] = np.abs(table_[a[at], i : i + 8] - table_[b[at], i : i + 8]).max(axis=1, initial=0) <= RADIUS
    at = np.flatnonzero(near)
    near[at] = np.bitwise_count(prints[a[at]] ^ prints[b[at]]) <= RADIUS
    return near


def _stars(prints: np.ndarray) -> list[tuple[int, int]]:
    """Distinct fingerprints: (member, root) of every connected part, found without listing a large group's pairs."""
    parent = np.arange(len(prints))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(at: np.ndarray, t: np.ndarray) -> None:
        n = len(at)
        if n < 2:
            return
        if n <= DENSE:
            a, b = np.triu_indices(n, 1)
            ok = _surviving(prints[at], t, a, b)
            for i, j in zip(at[a[ok]].tolist(), at[b[ok]].tolist(), strict=True):
                i, j = root(i), root(j)
                if i != j:
                    parent[max(i, j)] = min(i, j)
            return
        own = prints[at]
        varying = np.bitwise_or.reduce(own) & ~np.bitwise_and.reduce(own)
        bits = [k for k in range(64) if int(varying) >> k & 1]
        for part in range(RADIUS + 1):  # three differing bits leave one of four parts alone
            mask = np.uint64(sum(1 << k for k in bits[part :: RADIUS + 1]))
            key = own & mask
            order = np.argsort(key, kind="stable")
            cut = np.flatnonzero(np.diff(key[order])) + 1
            for group in np.split(order, cut):
                join(at[group], t[group])

    join(np.arange(len(prints)), pivot_table(prints))
    return [(int(prints[i]), int(prints[r])) for i in range(len(prints)) if (r := root(i)) != i]


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _bucket_links(batches):
    """Rows come sorted by (combo, key, fp): pairs inside runs of equal (combo, key). A run may span batches."""

    def small(combo, key, prints):
        """All runs up to DENSE of a stretch of whole runs: pairs at every lag inside a run."""
        t, out = None, []
        new = np.concatenate([[True], (combo[1:] != combo[:-1]) | (key[1:] != key[:-1])])
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(key)))
        run = np.repeat(np.arange(len(start)), size)
        for big in np.flatnonzero(size > DENSE):
            out += _stars(prints[start[big] : start[big] + size[big]])
        longest = int(size[size <= DENSE].max(initial=1))
        if longest > 1:
            t = pivot_table(prints)
        inside = size[run] <= DENSE
        for lag in range(1, longest):
            a = np.flatnonzero((run[lag:] == run[:-lag]) & inside[:-lag])
            b = a + lag
            differ = prints[a] ^ prints[b]
            same = np.zeros(len(a), np.uint8)
            for i, block in enumerate(_BLOCKS):
                same |= ((differ & np.uint64(block)) == 0).astype(np.uint8) << i
            first = (_FIRST[same] == combo[a]) | (combo[a] == _SPLIT)
            a, b = a[first], b[first]
            ok = _surviving(prints, t, a, b)
            out += zip(prints[a[ok]].tolist(), prints[b[ok]].tolist(), strict=True)
        return out

    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for batch in batches:
        held.append(tuple(batch.column(n).to_numpy() for n in ("combo", "key", "fp")))
        combo, key = held[-1][:2]
        if not len(key) or (len(held) > 1 and (combo[-1], key[-1]) == (held[0][0][-1], held[0][1][-1]) == (combo[0], key[0])):
            continue  # one run so far
        combo, key, prints = (np.concatenate([h[i] for h in held]) for i in range(3))
        last = len(key) - int(np.argmax((combo[::-1] != combo[-1]) | (key[::-1] != key[-1])))
        if (combo[0], key[0]) == (combo[-1], key[-1]):
            held = [(combo, key, prints)]
            continue
        links = small(combo[:last], key[:last], prints[:last].view(np.uint64))
        yield _as_links(links)
        held = [(combo[last:], key[last:], prints[last:])]
    if held and sum(len(h[0]) for h in held):
        combo, key, prints = (np.concatenate([h[i] for h in held]) for i in range(3))
        yield _as_links(small(combo, key, prints.view(np.uint64)))


def _as_links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    got = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
    return record(_LINKS, a=pa.array(got[:, 0]), b=pa.array(got[:, 1]))


def dealt(rows: DataFrame) -> DataFrame:
    """(combo, key, fp) with every bucket above MOST split, exactly, by parts of the bits that vary inside it.

    Two fingerprints of a bucket that differ in RADIUS bits agree on one of RADIUS + 1 parts of the varying bits, so they
    still meet; each part has a varying bit, so its buckets are smaller. Whether any bucket is that large is told by a
    sample: a bucket that it overlooks is whole and right, only larger.
    """
    sampled = rows.where(F.pmod(F.xxhash64("fp"), F.lit(SAMPLED)) == 0).groupBy("combo", "key").agg(F.count("*").alias("n"))
    big = written(sampled.where(F.col("n") * SAMPLED > MOST / 2).select("combo", "key"), "large-buckets")
    n = big.count()
    if not n:
        return rows
    marked = F.broadcast(big) if n <= BROADCAST_ROWS else big
    done, rest = rows.join(marked, ["combo", "key"], "left_anti"), rows.join(marked, ["combo", "key"])
    while True:
        rest = written(rest.select("combo", "key", "fp"), "split-buckets")
        told = rest.groupBy("combo", "key").agg(F.count("*").alias("n"), F.bit_or("fp").alias("any"), F.bit_and("fp").alias("every"))
        told = written(told.withColumn("large", (F.col("n") > MOST) & (F.bit_count(F.col("any").bitwiseXOR(F.col("every"))) > RADIUS)), "split-sizes")
        total, large = told.agg(F.sum("n"), F.count_if("large")).first()
        done = done.unionByName(hot_join(rest.withColumn("b", F.xxhash64("combo", "key")), told.where("not large").select(F.xxhash64("combo", "key").alias("b"), "n"), "b", "n", total).select("combo", "key", "fp"))
        if not large:
            return done
        bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda k: F.getbit(F.col("any").bitwiseXOR(F.col("every")), k) == 1)
        part = lambda p: F.aggregate(F.filter(bits, lambda k, i: i % (RADIUS + 1) == p), F.lit(0).cast("long"), lambda m, k: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), k)))
        masks = told.where("large").select(F.xxhash64("combo", "key").alias("b"), "n", F.array(*[part(p) for p in range(RADIUS + 1)]).alias("masks"))
        parts = hot_join(rest.withColumn("b", F.xxhash64("combo", "key")), masks, "b", "n", total).select("b", "fp", F.posexplode("masks").alias("p", "m"))
        rest = parts.select(F.lit(_SPLIT).alias("combo"), F.xxhash64("b", "p", F.col("fp").bitwiseAND(F.col("m"))).alias("key"), "fp")


def links(prints: DataFrame) -> DataFrame:
    """(a, b): of distinct fingerprints ``fp``, pairs that connect exactly what links of RADIUS or fewer bits connect."""
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("combo"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(_MASKS)]))
    rows = dealt(prints.select("fp", keys.alias("k")).select("k.combo", "k.key", "fp"))
    return rows.repartition("combo", "key").sortWithinPartitions("combo", "key", "fp").mapInArrow(_bucket_links, "a long, b long")


def connected(pairs: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of every node's component, for nodes that are not their own root.

    Alternates large-star and small-star until the edges no longer change; every round is written, and the round before
    it deleted. A hub's rows are never gathered: its least neighbour is aggregated and broadcast to them.
    """
    edges = written(pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    told = lambda: tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    mark = told()
    for _ in range(rounds):
        if not mark[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("m", "u").alias("m"), "n")
        large = hot_join(both.where("v > u"), least, "u", "n", 2 * mark[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, name)
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        # In ``large`` every v is below its u: the small star of u is all its neighbours and u itself.
        pairs_ = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        small = hot_join(large, least, "u", "n", mark[0]).select(F.explode(pairs_).alias("e")).select("e.*")
        before, edges = edges, written(small.where("u <> v").distinct(), name)
        discard(before, large)
        now = told()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def classes(prints: DataFrame, linked: Callable[[DataFrame], DataFrame] = links) -> tuple[DataFrame, int]:
    """(fp, root, component_id, n) of the distinct fingerprints of ``prints``, and the number of all rows.

    ``prints`` are (doc_id, th, fp); ``linked`` connects classes (fp, first_id, first_th, n), where (first_id, first_th) is
    the row with the smallest doc_id, and n the number of rows.
    """
    first = F.coalesce(F.min_by("th", "doc_id"), F.min("th"))
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), first.alias("first_th"), F.count("*").alias("n")), "fingerprints")
    n, total = distinct.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    roots = connected(linked(distinct))
    rooted = written(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first_id", "n", F.coalesce("root", "fp").alias("root")), "rooted")
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("members"))
    return written(hot_join(rooted, named, "root", "members", n).select("fp", "root", "component_id", "n"), "classes"), total


def components(docs: DataFrame) -> DataFrame:
    """One row a document: its fingerprint in hex and its component."""
    prints = written(fingerprints(docs), "prints")
    named, total = classes(prints)
    return hot_join(prints, named, "fp", "n", total).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, prints: DataFrame | None = None, linked: Callable[[DataFrame], DataFrame] = links) -> DataFrame:
    """One document of each component, with all its columns: the smallest doc_id, of equal ones one text.

    ``prints`` are (doc_id, th, fp), connected by ``linked``; by default SimHash, within RADIUS.
    """
    prints = written(fingerprints(docs), "prints") if prints is None else prints
    table_, total = classes(prints, linked)
    named = hot_join(prints, table_, "fp", "n", total)
    head = F.col("doc_id").eqNullSafe(F.col("component_id"))
    heads = named.where(head)
    most = heads.groupBy("root").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    gone = named.where(~head).select("doc_id", "th")
    if most > 1:  # a doc_id on several rows: those with its smallest text hash stay, once
        kept = heads.groupBy("root").agg(F.min("th").alias("kept_th"))
        gone = gone.unionByName(heads.join(kept, "root").where("th <> kept_th").select("doc_id", "th"))
    gone = written(gone.select(F.col("doc_id").alias("_gone_id"), F.col("th").alias("_gone_th")).distinct(), "duplicates")
    key = "_quillgraph_th"

    few = gone.count() <= BROADCAST_ROWS
    rows = docs.withColumn(key, F.xxhash64("text"))
    out = rows.join(F.broadcast(gone) if few else gone, rows["doc_id"].cast("long").eqNullSafe(gone["_gone_id"]) & (rows[key] == gone["_gone_th"]), "left_anti")
    if most > 1:
        out = out.dropDuplicates(["doc_id", key])
    return out.drop(key)


def op7_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"))


QUERIES = {"op7_simhash_components": op7_simhash_components}
ORACLES: dict[str, str] = {}
