import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash

from quillgraph.llm import common, fingerprints, neardup, neighbours, packing, tokenizer
from tests.llm.cases import documents, nothing, texts

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, shard string, asks string")


def exact(rows, queries, k):
    fine = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for i, q in [x for x in fine if x[0] in queries]:
        near = sorted((float(np.sqrt(((v - q) ** 2).sum())), j) for j, v in fine if j != i)
        out[i] = near[:k]
    return out


def test_neighbours_recall(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = exact(rows, {i for i, _ in rows if i % 100 == 0}, 10)
    got = {}
    for r in neighbours.op5_multi_index_neighbours(spark, sf).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    assert got.keys() == want.keys()
    hits = sum(len({v for _, v in want[q]} & {v for _, _, v in got[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9
    for found in got.values():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, len(found) + 1)) and [x[1:] for x in found] == sorted(x[1:] for x in found)


def test_neighbours_with_copies_clusters_and_odd_rows(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 8))
    rows = [(i, (centres[i % 20] + 0.05 * rng.normal(size=8)).tolist()) for i in range(1500)]
    rows += [(2000 + i, centres[3].tolist()) for i in range(900)]
    rows += [(5000, None), (5100, [0.0] * 8), (5200, [float("nan")] * 8), (5300, [float("inf")] + [1.0] * 7), (5400, [1.0, None] + [1.0] * 6), (None, [1.0] * 8), (5500, [1.0, 2.0])]
    df = vectors(spark, [(i, v, 1, "s", "a") for i, v in rows])
    got = {}
    for r in neighbours.search(df, df.where("vec_id % 100 = 0")).collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    want = exact([x for x in rows if x[1] is None or len(x[1]) == 8], {i for i, _ in rows if i is not None and i % 100 == 0}, 10)
    assert got.keys() == want.keys()
    hits = sum(len({v for _, v in want[q]} & {v for _, v in got[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9
    copies = sorted(got[2000])
    assert [v for _, v in copies] == list(range(2001, 2011)) and all(s == 0 for s, _ in copies)


def test_neighbours_in_each_dimension(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "FEW_ROWS", 100)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(30, 8))
    rows = [(i, (centres[i % 30] + 0.05 * rng.normal(size=8)).tolist()) for i in range(600)]
    odd = [(1000 + i, rng.normal(size=9).tolist()) for i in range(40)] + [(2000, rng.normal(size=12).tolist())]

    def found(given):
        df = vectors(spark, [(i, v, 1, "s", "a") for i, v in given])
        return {(r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.search(df, df.where("vec_id % 20 = 0")).collect()}

    alone, both = found(rows), found(rows + odd)
    assert len(alone) == 30 * 10 and {r for r in both if r[0] < 1000} == alone
    want = exact(odd[:-1], {1000, 1020}, 10)
    assert {(q, i + 1, v, d) for q, near in want.items() for i, (d, v) in enumerate(near)} == {r for r in both if r[0] >= 1000}


def test_neighbours_of_few_rows(spark):
    df = vectors(spark, [(0, [1.0], 1, "", ""), (1, [2.0], 1, "", ""), (2, [3.5], 1, "", "")])
    assert [(r["rank"], r.vec_id, r.score) for r in neighbours.search(df, df.where("vec_id = 0")).orderBy("rank").collect()] == [(1, 1, 1.0), (2, 2, 2.5)]
    two = vectors(spark, [(0, [1.0, 0.0], 1, "", ""), (1, [1.0, 1.0], 1, "", "")])
    assert [tuple(r) for r in neighbours.search(two, two).orderBy("query_id").collect()] == [(0, 1, 1, 1.0), (1, 1, 0, 1.0)]
    assert neighbours.search(vectors(spark, []), vectors(spark, [])).count() == 0


def test_walk_is_by_summed_distance():
    rng = np.random.default_rng(4)
    index = neighbours.Index(rng.normal(size=(7, 3)), rng.normal(size=(9, 3)))
    index.counts = rng.integers(0, 4, 63)
    q = rng.normal(size=6)
    order = index.walk(q, np.inf)
    sums = [((index.first[c // 9] - q[:3]) ** 2).sum() + ((index.second[c % 9] - q[3:]) ** 2).sum() for c in order.tolist()]
    assert sums == sorted(sums) and sorted(order.tolist()) == np.flatnonzero(index.counts).tolist()


def true_likeness(a, b):
    a, b = (set(fingerprints.shingle_hashes(x).tolist()) for x in (a, b))
    return len(a & b) / len(a | b) if a | b else 1.0


def kept_likeness(a, b):
    """By brute force: the hashes below the fixed fraction of all, and the texts themselves where there are none."""
    kept = [{h for h in fingerprints.shingle_hashes(x).tolist() if h * fingerprints.SCALE < 1 << 64} for x in (a, b)]
    return len(kept[0] & kept[1]) / len(kept[0] | kept[1]) if kept[0] | kept[1] else float(a == b)


def test_sketches_beside_next(spark):
    given = [(i, t) for i, t in enumerate(texts())]
    docs = documents(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = {r.doc_id: r for r in fingerprints.beside_next(docs).collect()}
    assert len(rows) == len(given)
    order = sorted(given, reverse=True)
    for (i, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        text, after = text or "", after or ""
        n = len(text) // 3
        edited = text[: len(text) - n] + after[:n]
        r = rows[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == fingerprints.rendered(fingerprints.sketch(text)) and r.edited_fingerprint == fingerprints.rendered(fingerprints.sketch(edited))
        assert r.near_edited == kept_likeness(text, edited) and r.near_next == kept_likeness(text, after)
        if min(len(text.split()), len(after.split())) > 300:
            assert abs(r.near_edited - true_likeness(text, edited)) < 0.15 and abs(r.near_next - true_likeness(text, after)) < 0.15


def test_sketches_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 3)
    rng = random.Random(8)
    given = [(rng.randint(-5_000, 5_000) * 10 + i % 10, f"text number {i} of a few words more {rng.random()}") for i in range(1000)]
    given = list(dict(given).items())
    docs = spark.createDataFrame(given, "doc_id long, text string").repartition(5)
    rows = {r.doc_id: r.edited_sha256 for r in fingerprints.beside_next(docs).collect()}
    order = sorted(given, reverse=True)
    want = {i: hashlib.sha256(fingerprints.edited(t, after).encode()).hexdigest() for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True)}
    assert rows == want


def test_sketches_of_many_rows_of_one_number(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 10)
    given = [(7, f"text {i} of one number") for i in range(300)] + [(None, f"text {i} of none") for i in range(200)] + [(i, f"text {i}") for i in range(8, 60)] + [(7, "text 1 of one number")] * 30
    rows = fingerprints.beside_next(spark.createDataFrame(given, "doc_id long, text string").repartition(4)).collect()
    ordered = spark.createDataFrame(given, "doc_id long, text string").selectExpr("doc_id", "text", "xxhash64(text) as h").collect()
    ordered = sorted(ordered, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.h, r.text))
    want = [(r.doc_id, hashlib.sha256(fingerprints.edited(r.text, after.text).encode()).hexdigest()) for r, after in zip(ordered, ordered[1:] + ordered[:1], strict=True)]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, r.edited_sha256) for r in rows), key=key) == sorted(want, key=key)


def test_sketch_edge_cases(spark):
    docs = documents(spark)
    assert fingerprints.beside_next(docs).count() == docs.count()
    assert fingerprints.beside_next(nothing(spark)).count() == 0
    one = spark.createDataFrame([(4, "just one text")], "doc_id long, text string")
    assert [(r.doc_id, r.near_next) for r in fingerprints.beside_next(one).collect()] == [(4, 1.0)]
    only_null = spark.createDataFrame([(None, "a b c"), (None, "d e f")], "doc_id long, text string")
    assert fingerprints.beside_next(only_null).count() == 2
    assert fingerprints.sketches(docs).count() == docs.count()


def test_sketch_containment_of_very_unequal_texts():
    words = [f"w{random.Random(i).random()}" for i in range(30_000)]
    long, short = " ".join(words), " ".join(words[10_000:11_500])
    a, b = fingerprints.sketch(short), fingerprints.sketch(long)
    assert abs(fingerprints.compare(a, b)[1] - 1) < 0.05 and fingerprints.compare(a, b)[2] < 0.1
    union = fingerprints.merge(fingerprints.sketch(" ".join(words[:15_000])), fingerprints.sketch(" ".join(words[15_000:])))
    assert fingerprints.compare(union, b)[0] > 0.99


def plain_fingerprint(text):
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text)) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """{doc_id: smallest reachable} over (doc_id, fp), all pairs."""
    own = sorted({f for _, f in prints})
    root = list(range(len(own)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(own)):
        for j in range(i):
            if (own[i] ^ own[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for d, f in prints:
        r = find(own.index(f))
        least[r] = min(least.get(r, d), d)
    return {d: least[find(own.index(f))] for d, f in prints}


def test_near_duplicates_against_all_pairs(spark):
    docs = documents(spark).where("doc_id is not null")
    want = plain_components([(i, plain_fingerprint(t or "")) for i, t in enumerate(texts())])
    rows = neardup.components(docs).collect()
    assert len(rows) == docs.count()
    assert {r.doc_id: r.component_id for r in rows} == want
    assert {r.doc_id: r.fingerprint for r in rows} == {i: f"{plain_fingerprint(t or ''):016x}" for i, t in enumerate(texts())}


def test_near_duplicates_on_a_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = neardup.op7_simhash_components(spark, sf).collect()
    prints = [(r.doc_id, int(r.fingerprint, 16)) for r in rows]
    assert {r.doc_id: r.component_id for r in rows} == plain_components(prints)


@pytest.mark.parametrize("most", [65_536, 100])
def test_links_of_dense_groups(spark, monkeypatch, most):
    rng = np.random.default_rng(9)
    centre = int(rng.integers(0, 1 << 63))
    prints = {centre}
    for _ in range(1500):  # a walk and a cloud: long chains, many fingerprints in the same buckets
        f = rng.choice(list(prints)) if rng.random() < 0.3 else centre
        for b in rng.choice(18, rng.integers(1, 6), replace=False):
            f = int(f) ^ (1 << int(b))
        prints.add(f)
    prints |= {int(x) for x in rng.integers(0, 1 << 63, 400)}
    prints = sorted(prints)
    monkeypatch.setattr(neardup, "DENSE", 40)
    monkeypatch.setattr(neardup, "MOST", most)
    monkeypatch.setattr(neardup, "SAMPLED", 2)
    df = spark.createDataFrame([(i, i, neardup._signed(f)) for i, f in enumerate(prints)], "doc_id long, th long, fp long")
    got = {r.fp: r.component_id for r in neardup.classes(df)[0].collect()}
    want = plain_components(list(enumerate(prints)))
    assert {i: got[neardup._signed(f)] for i, f in enumerate(prints)} == want


def test_a_hot_group_and_rows_without_numbers(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_KEYS", 3)  # the copies are broadcast, the others shuffled
    words = [f"word{i} and more of text{i} to read" for i in range(40)]
    rows = [(i, "one text that most rows hold here") for i in range(300)] + [(1000 + i, w) for i, w in enumerate(words)]
    rows += [(None, "a first text without a number"), (None, "a second text of no number at all"), (None, "a first text without a number")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    kept = sorted((r.doc_id is not None, r.doc_id or 0, r.text) for r in neardup.representatives(docs).collect())
    want = {(i is not None, i or 0, t) for i, t in rows if i is None or i == 0 or i >= 1000}
    assert kept == sorted(want)
    assert sorted((r.doc_id, r.component_id) for r in neardup.components(docs).collect() if r.doc_id is not None) == sorted((i, 0 if i < 300 else i) for i, _ in rows if i is not None)


def test_representatives(spark):
    docs = documents(spark)
    kept = neardup.representatives(docs)
    assert kept.columns == docs.columns
    want = set(plain_components([(i, plain_fingerprint(t or "")) for i, t in enumerate(texts())]).values())
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(want) and ids.count(None) <= 1
    assert neardup.representatives(nothing(spark)).count() == 0 and neardup.components(nothing(spark)).count() == 0


def plain_encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_tokenizer_against_the_library(spark, monkeypatch):
    monkeypatch.setattr(tokenizer, "BLOCK_CHARS", 5_000)
    extra = ["".join(map(chr, range(a, a + 400))) for a in range(0, 0x3000, 400)] + ["a\x1c b\x1d\x1e\x1f\x85c", "it's we'll 'S", "<|endoftext|>"]
    docs = documents(spark).unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"), allowMissingColumns=True)
    given = docs.select("doc_id", "text").collect()
    library = plain_encoding()
    want = sorted((-1 if r.doc_id is None else r.doc_id, library.encode_ordinary(r.text or "")) for r in given)
    coded = tokenizer.encoded(docs, RANKS, public_tokenizers.PATTERN)
    assert sorted((-1 if r.doc_id is None else r.doc_id, list(r.ids)) for r in coded.collect()) == want
    back = sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in tokenizer.decoded(coded, RANKS, public_tokenizers.PATTERN).collect())
    assert back == sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in given)
    assert tokenizer.encoded(nothing(spark), RANKS, public_tokenizers.PATTERN).count() == 0


def test_tokenizer_digests(spark, sf):
    library = plain_encoding()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = tokenizer.op9_byte_bpe(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = np.array(library.encode_ordinary(docs[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(docs[r.doc_id].encode()).hexdigest())


def test_packing_is_whole_and_fits(spark):
    docs = documents(spark)
    rows = packing.packed(docs).collect()
    words = sum(len((r.text or "").split()) for r in docs.collect())
    assert sum(r.length for r in rows) == words
    bins = {}
    for r in rows:
        assert (r.bin_id is None) == (r.length == 0)
        if r.length:
            bins.setdefault((r.bin_id, r.capacity), []).append((r.bin_offset, r.length))
    assert len({b for b, _ in bins}) == len(bins)
    for (_, size), held in bins.items():
        held.sort()
        ends = [0] + [a + n for a, n in held]
        assert [a for a, _ in held] == ends[:-1] and size == min(s for s in packing.LENGTHS if s >= ends[-1])
    assert len(rows) >= docs.count() and packing.packed(nothing(spark)).count() == 0


def test_best_fit_against_a_plain_search():
    rng = random.Random(11)
    for _ in range(60):
        pieces = sorted((rng.randint(1, 4096) if rng.random() < 0.5 else rng.randint(1, 300) for _ in range(200)), reverse=True)
        bins, _, sizes = packing.pack(pieces)
        room, mine, left = [], [], sum(pieces)
        for n in pieces:
            left -= n
            fits = [(r, i) for i, r in enumerate(room) if r >= n]
            if fits:
                r = min(fits)[0]
                assert room[bins[len(mine)]] == r, "not the tightest bin"
                i = bins[len(mine)]
            else:
                i = len(room)
                room.append(min((s for s in packing.LENGTHS if s >= n), key=lambda s: packing.cost(s) / min(s, n + left)))
            room[i] -= n
            mine.append(i)
        assert mine == bins
        assert sum(pieces) / sum(sizes) > 0.9


def test_pipeline(spark):
    import corpus_pipeline
    from quillgraph.llm.common import written

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs.count(), written(stage(spark, docs, sf), "test")
        assert docs.columns == columns and 0 < docs.count() <= before
    rows = corpus_pipeline.run(spark, sf)
    assert rows.select("doc_id").distinct().count() == docs.count()


def test_packing_does_not_depend_on_the_order_of_rows(spark):
    docs = documents(spark).unionByName(documents(spark, 2)).select("doc_id", "text")
    runs = [sorted(map(str, packing.packed(docs.repartition(n)).drop("bin_id").collect())) for n in (1, 5)]
    ids = [{(str(r.doc_id), r.piece, r.length, r.bin_id) for r in packing.packed(docs.repartition(n)).collect()} for n in (1, 5)]
    assert runs[0] == runs[1] and ids[0] == ids[1]


def test_packing_in_tokens(spark):
    docs = documents(spark)
    encode = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in (x.split() for x in open(RANKS, "rb").read().splitlines() if x)}, special_tokens={}).encode_ordinary
    got = {}
    for r in packing.packed(docs, packing.tokens_of(RANKS, public_tokenizers.PATTERN)).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + max(0, r.length)
    assert {i: got[i] for i, t in enumerate(texts()) if i != 8} == {i: len(encode(t or "")) for i, t in enumerate(texts()) if i != 8}  # row 8 is there three times
    assert got[8] == 3 * len(encode(texts()[8]))
