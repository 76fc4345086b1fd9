"""Cases from the findings of round 3."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.operators import causal, distances, fusion, layers, learning
from quillgraph.plans import numeric, registry
from quillgraph.plans.model import Model


def test_weights_are_learned_from_all_ratings(spark, monkeypatch):
    n = 20_050  # the last rated came first, 20,000 at most
    rows = spark.range(n).select(F.concat(F.lit("p"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("paper_id"), F.array(*[((F.col("id") * k) % 7 / 7.0).alias("s") for k in range(1, 15)]).alias("signals"), (F.col("id") % 10 + 1).cast("double").alias("user_rating"), F.col("id").cast("double").alias("rated_at"))
    x, y, r = learning.rated_matrix(rows.select("paper_id", "signals"), rows.select("paper_id", "user_rating", "rated_at"))
    at = np.arange(n)
    assert x.shape == (n, 14) and (r == at % 10 + 1).all() and (y == (r >= 7)).all()
    assert x == pytest.approx(np.stack([at * k % 7 / 7 for k in range(1, 15)], 1))
    want = learning.fit_weights(x, y)
    monkeypatch.setattr(learning, "FIT_ROWS", 3_000)
    assert learning.fit_weights(x, y) == pytest.approx(want, rel=1e-9)
    empty = learning.rated_matrix(rows.select("paper_id", "signals").limit(0), rows)
    assert empty[0].shape == (0, 14) and learning.learned(rows.limit(0).select("paper_id", "signals"), rows) == (None, None)


def test_parameters_are_tuned_on_all_ratings(spark, sf, monkeypatch):
    monkeypatch.setattr(learning, "MAX_RATED", 9, raising=False)
    monkeypatch.setattr(numeric, "_signals", lambda m: m.corpus.select("paper_id", F.array(*[F.pmod(F.col("ordinal") * k, F.lit(11)) / 11.0 for k in range(1, 15)]).alias("signals")))
    seen, whole = [], learning.rated_matrix
    monkeypatch.setattr(learning, "rated_matrix", lambda *a: seen.append(whole(*a)) or seen[-1])
    log = registry.queries()["tuned_parameters"](spark, sf).collect()
    assert len(log) == 12 and len(seen[0][2]) == Model(spark, sf).corpus.where("user_rating is not null").count() > 9


def test_auc_by_places_is_that_of_all_pairs():
    rng = np.random.default_rng(5)
    good, bad = rng.integers(0, 9, 57) / 9, rng.integers(0, 8, 41) / 9
    assert learning.auc(good, bad) == (np.sign(good[:, None] - bad[None]).mean() + 1) / 2
    assert learning.auc(good, bad[:0]) == learning.auc(good[:0], bad) == 0.0


def plain_communities(a):
    """``distances.greedy_communities`` by the gains of all pairs in each round."""
    groups = [[i] for i in range(len(a))]
    total, share = a.sum(), lambda g: a[g].sum() / a.sum()
    while True:
        tried = [(2 * (a[np.ix_(g, h)].sum() / total - share(g) * share(h)), x, y) for x, g in enumerate(groups) for y, h in enumerate(groups) if x < y and a[np.ix_(g, h)].any()]
        gain, x, y = max(tried, key=lambda t: (round(t[0], 12), -t[1], -t[2]), default=(0, 0, 0))
        if gain <= 1e-15:
            return groups
        groups[x] = sorted(groups[x] + groups.pop(y))


def graph(rng, n, part, weighted):
    a = np.triu((rng.random((n, n)) < part) * (rng.random((n, n)) if weighted else 1.0), 1)
    return a + a.T


def test_communities_by_bounds_are_those_of_all_gains():
    rng = np.random.default_rng(2)
    for weighted in (True, False, True, True):
        a = graph(rng, 30, 0.15, weighted)
        kept, found = a.copy(), distances.greedy_communities(a)
        assert (a == kept).all() and distances.greedy_communities(a.copy(), spare=True) == found
        if weighted:  # sums of equal gains differ in their last digits
            assert found == plain_communities(a)
    assert distances.greedy_communities(np.zeros((3, 3))) == [[0], [1], [2]]


@pytest.mark.parametrize("two_stage", [True, False])
def test_graphs_are_compared_in_tasks_as_by_whole_matrices(spark, monkeypatch, two_stage):
    monkeypatch.setattr(distances, "PLAIN_NODES", 5)
    monkeypatch.setattr(distances, "ROWS", 7)
    rng = np.random.default_rng(4)
    n, ids = 40, [f"p{i:02d}" for i in range(40)]
    a, b = graph(rng, n, 0.2, True), graph(rng, n, 0.1, False)
    if not two_stage:
        monkeypatch.setattr(distances, "_two_stage", lambda: None)
    assert distances.laplacian_values(a.copy()) == pytest.approx(distances.spectrum(a), abs=1e-10)
    pairs = lambda x: tuple(v for v in (*np.nonzero(np.triu(x)), x[np.nonzero(np.triu(x))]))
    assert distances.deltacon_pairs(n, pairs(a), pairs(b)) == pytest.approx(distances.deltacon(a, b), rel=1e-10)
    frames = [spark.createDataFrame([(ids[i], ids[j], float(x[i, j])) for i, j in zip(*np.nonzero(np.triu(x)))], "a string, b string, weight double") for x in (a, b)]
    groups = plain_communities(a)
    want = (distances.spectral_distance(a, b), distances.deltacon(a, b), distances.degree_ks(a, b), distances.modularity(a, groups), len(groups))
    assert distances.compared(*frames, ids) == pytest.approx(want, rel=1e-9)
    none = spark.createDataFrame([], "a string, b string, weight double")
    assert distances.compared(none, none, []) == (0.0, 1.0, 1.0, 0.0, 0) and distances.compared(none, none, ids[:3]) == (0.0, 1.0, 0.0, 0.0, 3)


def test_graph_distances_takes_more_than_4000_papers(spark):
    ids = [f"p{i:04d}" for i in range(4_100)]
    ring = spark.createDataFrame([(ids[i], ids[i + 1], 1.0) for i in range(0, 4_100, 2)], "a string, b string, weight double")
    spectral, like, ks, modular, communities = distances.compared(ring, ring, ids)
    assert (spectral, like, ks, communities) == (0.0, 1.0, 0.0, 2_050) and modular == pytest.approx(1 - 1 / 2_050)


def test_the_walk_holds_five_bytes_an_arc():
    rng = np.random.default_rng(6)
    n = 60
    src, dst, confidence = rng.integers(0, n, 900), rng.integers(0, n, 900), rng.choice([0.9, 0.35, 0.55, 0.25], 900)
    values = causal._values(np.unique(confidence))
    ahead, strength, loops = causal._lists(np.bincount(src, minlength=n).tolist(), lambda: ((x[low : low + 70] for x in (src, dst, confidence)) for low in range(0, 900, 70)), values)
    want = {}
    for s, t, c in zip(src.tolist(), dst.tolist(), confidence.tolist()):
        want[s, t] = max(want.get((s, t), 0), c)
    assert {(x, t): values[c] for x in range(n) for t, c in zip(ahead[x], strength[x])} == {e: c for e, c in want.items() if e[0] != e[1]}
    assert sorted(loops) == sorted((s, c) for s, t, c in zip(src.tolist(), dst.tolist(), confidence.tolist()) if s == t)
    assert sum(x.itemsize * len(x) for x in (*ahead, *strength)) == 5 * sum(s != t for s, t in want)


def test_penalties_need_no_shuffle_of_the_arcs(spark):
    columns = "paper_id string, year int, doi string, s2_id string, abstract string, authors array<string>, title string"
    full = ("10.1/x", "s1", "y" * 60, ["A"], "a title of some length")
    paper = lambda name, year, *x: (name, year, *(x or full))
    papers = spark.createDataFrame([paper("a", 2000), paper("b", 2005), paper("c", 2005), paper("n", None), paper("z", 2001, "", "", "", [], "")], columns)
    cited = spark.createDataFrame([("a", "b", "citation"), ("c", "b", "citation"), ("b", "n", "citation"), ("z", "b", "citation"), ("a", "c", "semantic")], "src string, dst string, etype string")
    arcs = spark.createDataFrame([("b", "a", 0.9, False), ("b", "c", 0.9, False), ("b", "n", 0.45, True), ("z", "b", 0.45, True), ("a", "c", 0.75, False), ("a", "z", 0.55, False), ("q", "a", 0.5, False)], "src string, dst string, confidence double, was_reversed boolean")
    made = causal.penalised(arcs, papers, cited)
    got = {(r.src, r.dst): (r.confidence, r.was_reversed, r.anomaly) for r in made.collect()}
    assert got == {
        ("b", "a"): (0.27, False, "future_citation"), ("b", "c"): (0.72, False, "same_year_citation"), ("b", "n"): (0.45, True, None), ("z", "b"): (0.108, True, "low_metadata"),
        ("a", "c"): (0.75, False, None), ("a", "z"): (0.44, False, "low_metadata"), ("q", "a"): (0.5, False, None),
    }
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("rounds, mirrored", [(1, True), (4, False), (15, True), (15, False)])
def test_large_networks_diffuse_from_tiles(spark, monkeypatch, rounds, mirrored):
    r = random.Random(11)
    ids = [f"p{i:02d}" for i in range(40)]
    frames = []
    for part in (0.3, 0.2):
        pairs = [(a, b, r.choice([0.25, 0.5, round(r.uniform(0.05, 0.9), 3)])) for a in ids[:-2] for b in ids if a < b and r.random() < part] + [("p03", "p03", 0.5)]
        one_way = [("p01", "q", 0.4)] * (part == 0.2 and not mirrored)
        frames.append(spark.createDataFrame(sorted({(s, t): (s, t, w) for a, b, w in pairs for s, t in ((a, b), (b, a))}.values()) + one_way, "src string, dst string, weight double").repartition(3))
    want = {(x.src, x.dst): x.weight for x in fusion.fuse(*frames, k=3, rounds=rounds).collect()}
    for name, size in (("DENSE_NODES", 5), ("PANEL_NODES", 20), ("STRIP", 3), ("TILE", 7), ("PACKED", 50), ("PANEL_CELLS", 200), ("PANEL_LEAST", 2)):
        monkeypatch.setattr(fusion, name, size, raising=False)
    monkeypatch.setattr(fusion, "product", lambda *_: pytest.fail("a join for every round"))
    written, whole = [], fusion.settled
    monkeypatch.setattr(fusion, "settled", lambda df, name: written.append(name) or whole(df, name))
    found = fusion.fuse(*frames, k=3, rounds=rounds, **({"mirrored": True} if mirrored else {})).collect()
    got = {(x.src, x.dst): x.weight for x in found}
    assert len(got) == len(found) and got.keys() == want.keys()
    assert all(got[e] == pytest.approx(w, rel=1e-9, abs=1e-12) and got[e] == got[e[::-1]] for e, w in want.items())
    assert set(written) == {"ends", "tiles-0", "tiles-1"}  # the networks once, no round and no result


def test_a_large_corpus_is_fused_without_tables_of_pairs(spark, sf, monkeypatch):
    want = {(x.src, x.dst): x.weight for x in registry.queries()["network_fusion"](spark, sf).collect()}
    for name, size in (("DENSE_NODES", 5), ("PANEL_NODES", 100), ("TILE", 64)):
        monkeypatch.setattr(fusion, name, size, raising=False)
    monkeypatch.setattr(layers, "BLOCK_PAPERS", 150)
    monkeypatch.setattr(Model, "semantic_edges", property(lambda m: pytest.fail("a layer with a row an edge")))
    monkeypatch.setattr(fusion, "product", lambda *_: pytest.fail("a join for every round"))
    found = registry.queries()["network_fusion"](spark, sf).collect()
    got = {(x.src, x.dst): x.weight for x in found}
    assert len(got) == len(found) and got.keys() == want.keys()
    assert all(got[e] == pytest.approx(w, rel=1e-9, abs=1e-12) for e, w in want.items())
