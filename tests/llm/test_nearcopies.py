"""The pipeline's near-duplicate stage against brute force over sets of five-word shingles."""

import random

import corpus_pipeline
from pyspark.sql import functions as F
from quillgraph.llm import nearcopies, neardup
from tests.llm.cases import documents, nothing


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def kept_by_brute_force(rows):
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return {rows[i][0] for i in range(len(rows)) if top(i) == i}


def edited(rng, words, n):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"e{rng.random()}"
    return " ".join(out)


def test_stage_links_copies_from_a_similarity_of_four_fifths(spark):
    rng = random.Random(3)
    texts = []
    for size, edits in ((100, 1), (100, 2), (300, 2), (300, 4), (300, 8), (1000, 10), (1000, 20), (1000, 30)):
        for _ in range(12):
            words = [f"w{rng.randrange(5000)}" for _ in range(size)]
            texts += [" ".join(words), edited(rng, words, edits)]
    hub = [f"w{rng.randrange(5000)}" for _ in range(200)]  # copies of a hub, alike to it and mostly not to each other
    texts += [edited(rng, hub, 4) for _ in range(40)] + [" ".join(hub), " ".join(hub).upper()]
    rows = list(enumerate(texts))
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "").collect()}
    assert kept == kept_by_brute_force(rows)


def test_stage_keeps_the_rest(spark):
    docs = documents(spark)
    kept = nearcopies.representatives(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=lambda i: -1 if i is None else i)
    assert ids == [None, 0, 3, 4, 5, 6, 7, 8, 12, 13, 14, 16, 17, 18, 19, 20, 21, 22]  # 10 is alike to 8: 51 of 61 shingles
    assert nearcopies.representatives(nothing(spark)).count() == 0


def test_simhash_brings_copies_together_and_links_are_verified(spark):
    """Without any minhash key: what op7's fingerprints link, if it is alike."""
    rng = random.Random(4)
    texts = []
    for _ in range(20):
        words = [f"w{rng.randrange(5000)}" for _ in range(1000)]
        texts += [" ".join(words), edited(rng, words, 1)]
    texts += ["a b c a b c a b c d", "a b c a b c a b c e"]  # nearly the same bits, other sets
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    signed = nearcopies.signatures(docs).withColumn("keys", F.array().cast("array<long>"))
    classes = signed.select("fp", F.col("doc_id").alias("first_id"), F.col("th").alias("first_th"))
    found = {frozenset(r) for r in nearcopies.links(docs, signed, 0.8, classes).select("a", "b").collect()}
    ids = {r.fp: r.doc_id for r in signed.collect()}
    places = {frozenset(ids[x] for x in pair) for pair in found}
    assert places and places <= {frozenset((2 * i, 2 * i + 1)) for i in range(20)}
    bits = [neardup.fingerprint(t) for t in texts]
    assert {frozenset((2 * i, 2 * i + 1)) for i in range(20) if (bits[2 * i] ^ bits[2 * i + 1]).bit_count() <= neardup.RADIUS} == places
