import random

import numpy as np
import pytest

from quillgraph.operators import citations as C
from quillgraph.operators import graph as G
from quillgraph.operators import layers
from quillgraph.plans import registry
from quillgraph.plans.model import Model


@pytest.fixture(scope="module")
def world(spark):
    """Thirty papers: their vectors, reference lists with repeats, direct citations."""
    r = random.Random(5)
    ids = [f"p{i}" for i in range(30)]
    vectors = {p: [r.uniform(-1, 1) for _ in range(4)] for p in ids}
    lists = {p: [f"r{r.randrange(25)}" for _ in range(r.randrange(6))] for p in ids}
    direct = {(r.choice(ids), r.choice(ids)) for _ in range(25)}
    direct = {(a, b) for a, b in direct if a != b} | {("p1", "p2"), ("p2", "p1")}
    frames = (
        spark.createDataFrame([(p, v) for p, v in vectors.items()], "id string, embedding array<double>"),
        spark.createDataFrame([(p, x) for p, xs in lists.items() for x in xs], "paper_id string, ref_id string"),
        spark.createDataFrame(sorted(direct), "src string, dst string"),
    )
    return ids, vectors, {p: set(xs) for p, xs in lists.items()}, direct, frames


def brute(world, threshold):
    ids, vectors, lists, direct, _ = world
    for a in ids:
        for b in ids:
            if a < b:
                sim, shared = float(np.dot(vectors[a], vectors[b])), len(lists[a] & lists[b])
                if sim >= threshold or shared or (a, b) in direct or (b, a) in direct:
                    yield a, b, sim if sim >= threshold else None, shared or None, shared / (len(lists[a]) * len(lists[b])) ** 0.5 if shared else None, (a, b) in direct, (b, a) in direct


@pytest.mark.parametrize("size", [4, 7, 1_000])
def test_pairs_of_all_layers_are_the_brute_ones(world, monkeypatch, size):
    monkeypatch.setattr(layers, "BLOCK_PAPERS", size)
    monkeypatch.setattr(layers, "SHARD_REFS", 20)
    vectors, refs, direct = world[4]
    got = layers.pairs(layers.numbered(vectors.select("id"), refs), refs, vectors, 0.3, direct).collect()
    want = sorted(brute(world, 0.3))
    assert [tuple(r[c] for c in ("a", "b", "shared", "ab", "ba")) for r in sorted(got)] == [(a, b, s, ab, ba) for a, b, _, s, _, ab, ba in want]
    for r, w in zip(sorted(got), want, strict=True):
        assert (r.sim, r.weight) == (pytest.approx(w[2]), pytest.approx(w[4]))


def test_coupling_in_chunks_of_a_few_cells(world, monkeypatch):
    monkeypatch.setattr(C, "CHUNK_PAPERS", 9)
    _, refs, _ = world[4]
    got = {(r.a, r.b): r.shared for r in C.coupling(refs).collect()}
    assert got == {(a, b): s for a, b, _, s, _, _, _ in brute(world, 99.0) if s} and C.coupling(refs.limit(0)).count() == 0


@pytest.mark.parametrize("overlay", [False, True])
def test_walk_over_packed_arcs_is_pagerank(spark, world, monkeypatch, overlay):
    monkeypatch.setattr(layers, "BLOCK_PAPERS", 7)
    vectors, refs, direct = world[4]
    places = layers.numbered(vectors.select("id"), refs)
    arcs = {}
    for a, b, sim, shared, weight, ab, ba in brute(world, 0.3):
        coupled = round(weight + 1e-12, 4) if shared and not ab and not ba else None
        for x, y, on in ((a, b, ab), (b, a, ba)):
            if overlay:
                w = 1.0 if on else coupled if coupled is not None else sim
            else:
                w = 1.0 if ab or ba else max(v for v in (coupled, sim) if v is not None)
            if w is not None:
                arcs[x, y] = w
    edges = spark.createDataFrame([(a, b, w) for (a, b), w in arcs.items()], "src string, dst string, weight double")
    restart = spark.createDataFrame([("p3", 0.75), ("p9", 0.25)], "id string, share double")
    got = {r.id: r for r in layers.walk(places, layers.packed(places, refs, vectors, 0.3, direct, overlay), restart).collect()}
    want = {r.id: r["rank"] for r in G.pagerank(vectors.select("id"), edges, restart).collect()}
    assert len(got) == 30 and all(got[p]["rank"] == pytest.approx(w, rel=1e-9, abs=1e-15) for p, w in want.items())
    assert {p: r.degree for p, r in got.items()} == {r.id: r.degree for r in G.degrees(edges, vectors.select("id")).collect()}


#: Queries that wrote or shuffled a row a pair of papers, by finding.
NO_PAIRS = {
    1: "arguments", 2: "blended_relevance", 3: "edge_type_histogram", 4: "edges_removed", 5: "feasible_arguments", 6: "learned_weights", 7: "mmr_slate", 8: "paper_connections", 9: "rank_candidates",
    10: "score_candidates", 11: "sig_network", 12: "tuned_parameters", 18: "causal_orientation", 20: "citation_lineages", 21: "combined_degree", 22: "bridge_papers", 24: "context_facts",
}


@pytest.mark.parametrize("name", NO_PAIRS.values())
def test_query_makes_no_table_of_all_edges(name, spark, sf, monkeypatch):
    for layer in ("semantic_edges", "citation_edges", "combined_edges"):
        monkeypatch.setattr(Model, layer, property(lambda m: pytest.fail("a layer with a row an edge")))
    assert registry.queries()[name](spark, sf).count() >= 0


@pytest.mark.parametrize("name", ["citation_edges", "combined_layer", "annotated_citations"])
def test_rows_of_a_pair_leave_without_a_shuffle(name, spark, sf):
    plan = registry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "HashAggregate" not in plan.split("FlatMapGroupsInArrow")[0]
