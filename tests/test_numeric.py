import numpy as np
import pytest

from quillgraph.operators import causal, distances, fusion, hierarchy, learning, ranking


def brute_ward(x):
    groups = {i: [i] for i in range(len(x))}
    out = []
    while len(groups) > 1:
        best = None
        for a in groups:
            for b in groups:
                if a < b:
                    p, q = x[groups[a]], x[groups[b]]
                    d = 2 * len(p) * len(q) / (len(p) + len(q)) * ((p.mean(0) - q.mean(0)) ** 2).sum()
                    if best is None or d < best[0]:
                        best = (d, a, b)
        d, a, b = best
        out.append(np.sqrt(d))
        groups[a] = groups[a] + groups.pop(b)
    return np.array(out)


def test_ward_merges_like_a_plain_search():
    x = np.random.default_rng(1).normal(size=(40, 5))
    merges = hierarchy.ward(x)
    np.testing.assert_allclose(merges[:, 2], brute_ward(x), rtol=1e-8)
    assert merges[-1, 3] == 40


def test_cuts_find_the_clusters():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(4, 8)) * 20
    x = np.concatenate([c + rng.normal(size=(15, 8)) for c in centres])
    labels = hierarchy.cut(hierarchy.ward(x), clusters=4)
    assert len({tuple(labels[i * 15 : (i + 1) * 15]) for i in range(4)}) == 4 and all(len(set(labels[i * 15 : (i + 1) * 15])) == 1 for i in range(4))
    sizes = [int(v.max()) + 1 for v in hierarchy.levels(hierarchy.ward(x), most=60)]
    assert 4 in sizes and sizes == sorted(sizes, reverse=True) and len(hierarchy.levels(hierarchy.ward(x))) <= hierarchy.MAX_LEVELS


def test_large_corpora_are_clustered_by_centroids(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "MAX_POINTS", 60)
    rng = np.random.default_rng(3)
    rows = [(f"p{i}", (np.eye(6)[i % 6] * 10 + rng.normal(size=6) * 0.1).tolist()) for i in range(240)]
    got = hierarchy.memberships(spark.createDataFrame(rows, "paper_id string, embedding array<double>")).collect()
    assert {r.paper_id for r in got} == {p for p, _ in rows}


def test_components_are_centred():
    x = np.random.default_rng(4).normal(size=(30, 100)) + 5
    y = hierarchy.centred_components(x, 10)
    assert y.shape == (30, 10) and abs(y.mean()) < 1e-9
    assert hierarchy.centred_components(x[:, :5], 10).shape == (30, 5)


def dense_fusion(w1, w2, alpha, k, rounds):
    scale = lambda w: (w - w.min()) / (w.max() - w.min())
    norm = lambda w: w / np.where(w.sum(1, keepdims=True) < 1e-12, 1, w.sum(1, keepdims=True))

    def kernel(w):
        out = np.zeros_like(w)
        for i in range(len(w)):
            top = [j for j in sorted(range(len(w)), key=lambda j: (-round(w[i, j], 9), f"n{j:02d}")) if w[i, j] > 0][:k]
            out[i, top] = w[i, top]
        return norm((out + out.T) / 2)

    w1, w2 = scale(w1), scale(w2)
    k1, k2, p1, p2 = kernel(w1), kernel(w2), norm(w1), norm(w2)
    for _ in range(rounds):
        p1, p2 = norm(k1 @ p2 @ k1.T), norm(k2 @ p1 @ k2.T)
    out = alpha * p1 + (1 - alpha) * p2
    return scale((out + out.T) / 2)


def test_fusion_is_the_dense_computation(spark):
    rng = np.random.default_rng(5)

    def network():
        w = np.where(rng.random((12, 12)) < 0.6, rng.random((12, 12)), 0)
        w = np.triu(w, 1)
        return w + w.T

    def table(w):
        return spark.createDataFrame([(f"n{i:02d}", f"n{j:02d}", float(w[i, j])) for i in range(12) for j in range(12) if w[i, j] > 0], "src string, dst string, weight double")

    a, b = network(), network()
    want = dense_fusion(a, b, 0.6, 3, 3)
    got = {(r.src, r.dst): r.weight for r in fusion.fuse(table(a), table(b), 0.6, 3, 3).collect()}
    for i in range(12):
        for j in range(12):
            assert abs(got.get((f"n{i:02d}", f"n{j:02d}"), 0.0) - want[i, j]) < 1e-9
    sparse = table(b).limit(1)
    assert fusion.fuse(table(a), sparse, sparse=0.5).count() == table(a).count()
    assert fusion.fuse(table(a).limit(0), table(b)).count() == table(b).count()


def is_acyclic(rows):
    after = {}
    for s, t, *_ in rows:
        after.setdefault(s, set()).add(t)
    state = {}

    def visit(n):
        if state.get(n) == 1:
            return False
        if state.get(n) == 2:
            return True
        state[n] = 1
        fine = all(visit(t) for t in after.get(n, ()))
        state[n] = 2
        return fine

    return all(visit(n) for n in list(after))


def test_cycles_are_broken_at_their_weakest_edge():
    rows = causal.break_cycles([("A", "B", 0.9), ("B", "C", 0.8), ("C", "A", 0.3)])
    assert is_acyclic(rows) and ("A", "C", 0.15, True) in rows and ("A", "B", 0.9, False) in rows
    rng = np.random.default_rng(6)
    for _ in range(30):
        arcs = [(f"n{a}", f"n{b}", float(rng.random())) for a, b in rng.integers(0, 12, (40, 2)) if a != b]
        assert is_acyclic(causal.break_cycles(arcs))


def test_acyclic_leaves_the_rest_alone(spark):
    rows = [("A", "B", 0.9), ("B", "C", 0.8), ("C", "A", 0.3), ("A", "X", 0.5), ("Y", "A", 0.5)]
    got = [tuple(r) for r in causal.acyclic(spark.createDataFrame(rows, "src string, dst string, confidence double")).collect()]
    assert is_acyclic(got) and ("A", "X", 0.5, False) in got and ("Y", "A", 0.5, False) in got and len(got) == 5


def brute_mmr(scores, v, n):
    picked, left = [], list(range(len(scores)))
    while left and len(picked) < n:
        value = lambda i: 0.7 * scores[i] - 0.3 * max((float(v[i] @ v[p]) for p in picked), default=0.0)
        best = max(left, key=lambda i: (round(value(i), 11), -i))
        picked.append(best)
        left.remove(best)
    return picked


def test_greedy_slate_is_the_plain_search(spark):
    rng = np.random.default_rng(7)
    for _ in range(20):
        s, v = np.sort(rng.random(30))[::-1], rng.normal(size=(30, 6))
        assert ranking.greedy(s, v, 8) == brute_mmr(s, v, 8)
    rows = [(f"p{i}", 0.9 - i / 100, v[i].tolist()) for i in range(30)]
    got = ranking.diversified(spark.createDataFrame(rows, "id string, score double, embedding array<double>"), 8).orderBy("rank").collect()
    assert [r.id for r in got] == [f"p{i}" for i in brute_mmr([r[1] for r in rows], v, 8)]


def test_scout_slate_drops_redundant_finds(spark):
    rows = [("a", 0.9, [1.0, 0.0]), ("b", 0.3, [1.0, 0.0]), ("c", 0.3, [0.0, 1.0])]
    got = ranking.scout_slate(spark.createDataFrame(rows, "id string, score double, embedding array<double>")).orderBy("rank").collect()
    assert [r.id for r in got] == ["a", "c"]


def test_weights_follow_the_ratings():
    rng = np.random.default_rng(8)
    x = rng.random((40, 14))
    y = (x[:, 3] > 0.5).astype(float)
    w = learning.fit_weights(x, y)
    assert w.argmax() == 3 and w.min() > 0 and abs(w.sum() - sum(learning.SIGNAL_WEIGHTS)) < 1e-9
    e = learning.ensemble(x, y)
    assert e.shape == (12, 14) and (learning.ensemble(x, y) == e).all() and learning.ensemble(x[:5], y[:5]) is None


def test_uncertainty_is_the_spread_of_the_ensemble(spark):
    e = np.random.default_rng(9).random((12, 14)) + 0.1
    s, mask = np.random.default_rng(10).random(14), np.ones(14)
    df = spark.createDataFrame([("p", s.tolist(), mask.tolist())], "paper_id string, signals array<double>, mask array<double>")
    row = learning.uncertainty(df, e[0], e).first()
    scores = [(s @ w) / w.sum() for w in e]
    assert row.sigma == pytest.approx(np.std(scores)) and row.score == pytest.approx(scores[0])
    assert learning.uncertainty(df, e[0], None).first().sigma == 0.0


def test_tuning_keeps_only_what_helps():
    best, log = learning.tune(lambda p: (1 - abs(p["a"] - 0.7), 1 - abs(p["a"] - 0.7)), {"a": (0.0, 1.0, 0.3)}, {"a": 0.1}, rounds=30)
    assert abs(best["a"] - 0.7) < 0.1 and any(e["kept"] for e in log) and not all(e["kept"] for e in log)
    stuck, _ = learning.tune(lambda p: (p["a"], -p["a"]), {"a": (0.0, 1.0, 0.3)}, {"a": 0.1}, rounds=10)
    assert stuck["a"] == 0.1


def path(n):
    a = np.zeros((n, n))
    for i in range(n - 1):
        a[i, i + 1] = a[i + 1, i] = 1
    return a


def test_graph_distances():
    star = np.zeros((4, 4))
    star[0, 1:] = star[1:, 0] = 1
    assert distances.degree_ks(path(4), star) == 0.25
    assert distances.spectral_distance(path(5), path(5)) == pytest.approx(0) and distances.spectral_distance(path(5), path(8)) > 0
    assert distances.deltacon(path(4), path(4)) == 1.0 > distances.deltacon(path(4), star) > 0
    with pytest.raises(ValueError):
        distances.deltacon(path(4), path(5))
    two = np.zeros((6, 6))
    for a, b in ((0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (2, 3)):
        two[a, b] = two[b, a] = 1
    groups = distances.greedy_communities(two)
    assert groups == [[0, 1, 2], [3, 4, 5]] and distances.modularity(two, groups) > 0.2
    assert distances.path_lengths(path(4)) == (10 / 6, 3.0)
    same = distances.embedding_costs(np.eye(5))
    assert distances.gromov_wasserstein(same, same) < 0.35 and distances.gromov_wasserstein(same, np.empty((0, 0))) is None
