"""Cases from the findings of round 2: where a query did not end at size."""

import random
import time

import numpy as np
import pytest

from quillgraph.functions import store
from quillgraph.operators import causal, citations, fusion, layers, scoring
from quillgraph.operators import graph as G
from quillgraph.plans import model, registry
from quillgraph.plans.model import Model


def naive_walk(rows):
    """``causal.break_cycles`` step by step: from the smallest node left, always on to the smallest neighbour that is not done."""
    out, done, turned = {}, set(), set()
    for s, t, c in rows:
        out.setdefault(s, {})[t] = (c, False)
        out.setdefault(t, {})
    for first in sorted(out):
        path = [] if first in done else [first]
        while path:
            at = path[-1]
            nxt = min((n for n in out[at] if n not in done), default=None)
            if nxt is None:
                done.add(path.pop())
            elif nxt not in path:
                path.append(nxt)
            else:
                ring = path[path.index(nxt) :]
                s, t = min(zip(ring, ring[1:] + ring[:1]), key=lambda e: (out[e[0]][e[1]][0], e))
                c, _ = out[s].pop(t)
                if frozenset((s, t)) not in turned:
                    turned.add(frozenset((s, t)))
                    out[t][s] = max((max(0.10, c / 2), True), out[t].get(s, (0.0, False)))
                del path[path.index(s) + 1 :]
    return {(s, t, c, r) for s, ts in out.items() for t, (c, r) in ts.items()}


def test_a_cyclic_core_of_any_size_is_broken(spark, monkeypatch):
    monkeypatch.setattr(causal, "CORE_EDGES", 10, raising=False)
    monkeypatch.setattr(causal, "PACK_ROWS", 7, raising=False)
    monkeypatch.setattr(causal, "BATCH_ROWS", 5, raising=False)
    r = random.Random(3)
    inner = sorted({(f"p{r.randrange(12)}", f"p{r.randrange(12)}") for _ in range(60)})
    rows = [(s, t, r.choice([0.95, 0.9, 0.35, 0.15])) for s, t in inner if s != t]
    tail = [("p3", "x", 0.5), ("x", "y", 0.5), ("w", "p0", 0.5)]
    got = [tuple(x) for x in causal.acyclic(spark.createDataFrame(rows + tail, "src string, dst string, confidence double").repartition(3)).collect()]
    assert len(got) == len(set(got)) and set(got) == naive_walk(rows) | {(*e, False) for e in tail}
    assert causal.acyclic(spark.createDataFrame([], "src string, dst string, confidence double")).count() == 0


@pytest.mark.parametrize("rounds", [1, 4, 15])
def test_networks_above_the_dense_limit_diffuse_by_panels(spark, monkeypatch, rounds):
    r = random.Random(7)
    ids = [f"p{i:02d}" for i in range(30)]
    frames = []
    for part in (0.3, 0.2):
        pairs = [(a, b, round(r.uniform(0.05, 0.9), 3)) for a in ids[:-2] for b in ids if a < b and r.random() < part] + [("p03", "p03", 0.5)]
        frames.append(spark.createDataFrame(sorted({(s, t): (s, t, w) for a, b, w in pairs for s, t in ((a, b), (b, a))}.values()) + [("p01", "q", 0.4)] * (part == 0.2), "src string, dst string, weight double"))
    want = {(x.src, x.dst): x.weight for x in fusion.fuse(*frames, k=3, rounds=rounds).collect()}
    monkeypatch.setattr(fusion, "DENSE_NODES", 5)
    for name, size in (("PANEL", 7), ("STRIP", 3), ("PIECE", 4), ("WRITTEN", 2)):
        monkeypatch.setattr(fusion, name, size, raising=False)
    monkeypatch.setattr(fusion, "product", lambda *_: pytest.fail("a join for every round"))
    found = fusion.fuse(*frames, k=3, rounds=rounds).collect()
    got = {(x.src, x.dst): x.weight for x in found}
    assert len(got) == len(found) and got.keys() == want.keys()
    assert all(got[e] == pytest.approx(w, rel=1e-9, abs=1e-12) for e, w in want.items())


@pytest.mark.parametrize("bits", [64, 1 << 28])
def test_a_search_over_packed_pairs_finds_the_shortest_paths(spark, monkeypatch, bits):
    for name, size in (("BLOCK_PAPERS", 30), ("SEARCH_BITS", bits), ("GATHERED", 64), ("TASK_ROWS", 500)):
        monkeypatch.setattr(layers, name, size, raising=False)
    r = random.Random(2)
    papers = {f"p{i}": [r.uniform(-1, 1) for _ in range(3)] for i in range(90)} | {"apart": [0.0, 0.0, 0.0]}
    vectors = spark.createDataFrame(list(papers.items()), "id string, embedding array<double>")
    arcs = [(a, b) for a in papers for b in papers if a != b and sum(x * y for x, y in zip(papers[a], papers[b])) >= 0.9]
    sources = spark.createDataFrame([(f"p{i}",) for i in range(70)] + [("apart",)], "id string")
    want = {tuple(x) for x in G.hops(spark.createDataFrame(arcs, "src string, dst string"), sources, 4).collect()}
    got = [tuple(x) for x in layers.spread(layers.numbered(vectors.select("id")), vectors, 0.9, sources, 4).collect()]
    assert len(got) == len(set(got)) and set(got) == want and {h for *_, h in want} == {0, 1, 2, 3, 4}


def test_shortest_paths_makes_no_table_of_all_edges(spark, sf, monkeypatch):
    monkeypatch.setattr(Model, "semantic_edges", property(lambda m: pytest.fail("a layer with a row an edge")))
    assert registry.queries()["shortest_paths"](spark, sf).count() > 0


def test_the_citation_signal_hands_on_a_row_a_paper_and_not_a_pair(spark, monkeypatch):
    monkeypatch.setattr(layers, "BLOCK_PAPERS", 6)
    monkeypatch.setattr(layers, "SHARD_REFS", 20)
    r = random.Random(4)
    refs = sorted({(f"p{r.randrange(24)}", r.choice(["crossref", "openalex", "s2"]), f"r{r.randrange(30)}") for _ in range(160)})
    weights = {f"p{i}": float(i % 5) for i in range(20)}
    wanted = [f"p{i}" for i in range(14, 24)] + ["alone"]  # some are in the corpus too
    lists, sources = {}, {}
    for p, s, x in refs:
        lists.setdefault(p, set()).add(x)
        sources.setdefault(p, set()).add(s)
    support = {p: {1: 0.55, 2: 0.8}.get(len(s), 1.0) for p, s in sources.items()}
    want = {}
    for c in wanted:
        of = [len(k) / (len(lists[c]) * len(lists[m])) ** 0.5 * w / 10 * min(support[c], support[m]) for m, w in weights.items() if m != c and w > 0 and m in lists and (k := lists.get(c, set()) & lists[m])]
        want[c] = sum(of) / len(of) if of else 0.0
    frames = (spark.createDataFrame([(p,) for p in wanted], "paper_id string"), spark.createDataFrame(list(weights.items()), "paper_id string, weight double"), spark.createDataFrame(refs, "paper_id string, source string, ref_id string"))
    found = scoring.citation_signal(*frames)
    assert {x.paper_id: x.citation for x in found.collect()} == pytest.approx(want) and len(found.collect()) == len(want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(c#" not in plan and "hashpartitioning(ref_id" not in plan.split("FlatMapGroupsInArrow")[0]
    assert "hashpartitioning(x#" in plan


def test_score_candidates_writes_no_texts_no_layer_twice_and_deals_no_copies(spark, sf, monkeypatch):
    monkeypatch.setattr(model, "_SHARED", {})
    monkeypatch.setattr(Model, "papers", property(lambda m: pytest.fail("a table with the texts of all papers")))
    monkeypatch.setattr(layers, "_dealt", lambda *_: pytest.fail("a copy of every block for each other block in a shuffle"))
    monkeypatch.setattr(layers, "BLOCK_PAPERS", 150)
    written, settled = [], store.settled
    for module in (store, layers, citations):
        monkeypatch.setattr(module, "settled", lambda df, name: written.append(name) or settled(df, name))
    assert registry.queries()["score_candidates"](spark, sf).count() > 0
    assert "packed" in written and "packed-False" not in written and "places" not in written


def test_shuffle_files_go_with_the_table_that_needed_them(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        files = disk.getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    before = shuffles()
    table = store.settled(spark.range(1_000).groupBy("id").count().repartition(3), "counted")
    end = time.time() + 20
    while shuffles() - before and time.time() < end:
        time.sleep(0.2)
    assert not shuffles() - before and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    assert table.count() == 1_000


@pytest.mark.parametrize("kind", [np.uint16, float])
def test_packed_arcs_come_back_as_they_were(kind):
    r = np.random.default_rng(1)
    i, j, w = r.integers(0, 60_000, 500), r.integers(0, 65_536, 500), (r.random(500) * 9_999).astype(kind)
    for got, want in zip(layers._arcs_of(layers._pack(layers._arcs(i, j, w))), (i, j, w / 1e4 if kind is np.uint16 else w), strict=True):
        assert np.array_equal(got, want)
    assert [len(x) for x in layers._arcs_of(layers._pack(layers._arcs(i[:0], j[:0], w[:0])))] == [0, 0, 0]


@pytest.mark.parametrize("odd", [None, np.nan, np.inf])
def test_the_nearest_are_those_of_a_full_sort(odd):
    r = np.random.default_rng(2)
    a, b = r.normal(size=(20, 5)), np.repeat(r.normal(size=(30, 5)), 3, axis=0)  # every vector three times: ties
    if odd is not None:
        b[4, 2] = odd
    sims = np.zeros((20, 90))
    for i in range(5):
        sims += np.multiply.outer(a[:, i], b[:, i])
    for k in (1, 4, 89, 200):
        want = np.argsort(-sims, axis=1, kind="stable")[:, :k]
        rows, places, values = scoring._nearest(a, b, k)
        assert np.array_equal(places.reshape(20, -1), want) and np.array_equal(values, sims[rows, places], equal_nan=True)
