import pytest

from quillgraph.operators import exchange
from quillgraph.operators import graph as G


def edges(spark, rows):
    return spark.createDataFrame([(a, b, float(w)) for a, b, w in rows], "src string, dst string, weight double")


def nodes(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def test_degree_counts_both_ends_and_loops_twice(spark):
    got = {r.id: r.degree for r in G.degrees(edges(spark, [("a", "b", 1), ("b", "a", 1), ("c", "c", 1)]), nodes(spark, "abcd")).collect()}
    assert got == {"a": 2, "b": 2, "c": 2, "d": 0}


def test_hops_follow_direction_and_stop(spark):
    e = edges(spark, [("a", "b", 1), ("b", "c", 1), ("c", "d", 1), ("d", "e", 1), ("a", "c", 1)])
    got = {(r.source, r.id): r.hops for r in G.hops(e, nodes(spark, "a"), 3).collect()}
    assert got == {("a", "a"): 0, ("a", "b"): 1, ("a", "c"): 1, ("a", "d"): 2, ("a", "e"): 3}
    assert G.hops(e, nodes(spark, "e"), 3).count() == 1


def test_pagerank_sums_to_one_with_dangling_nodes(spark):
    ranks = {r.id: r["rank"] for r in G.pagerank(nodes(spark, "abcd"), edges(spark, [("a", "b", 1), ("b", "c", 2), ("b", "a", 1)]), rounds=12).collect()}
    assert sum(ranks.values()) == pytest.approx(1) and ranks["c"] > ranks["d"]
    assert G.pagerank(nodes(spark, ""), edges(spark, [])).count() == 0


def test_network_mass_leaves_out_the_restart(spark):
    e = edges(spark, [(f"p{i}", f"p{i + 1}", 1) for i in range(5)])
    restart = spark.createDataFrame([("p0", 9.0), ("p1", 9.0)], "id string, weight double")
    mass = {r.id: r.mass for r in G.network_mass(nodes(spark, [f"p{i}" for i in range(6)]), e, restart, rounds=15).collect()}
    assert max(mass.values()) == 1.0 and mass["p2"] > mass["p3"] > mass["p4"] > mass["p5"] > 0


def test_dag_and_levels(spark):
    assert G.is_dag(edges(spark, [("a", "b", 1), ("b", "c", 1), ("a", "c", 1)]))
    ring = edges(spark, [("x", "a", 1), ("a", "b", 1), ("b", "c", 1), ("c", "a", 1), ("c", "y", 1)])
    assert not G.is_dag(ring) and G.cyclic_core(ring).count() == 3 and G.is_dag(edges(spark, []))
    levels = {r.id: r.level for r in G.topological_levels(edges(spark, [("a", "b", 1), ("b", "c", 1), ("a", "c", 1)]), nodes(spark, "abc")).collect()}
    assert levels == {"a": 0, "b": 1, "c": 2}
    with pytest.raises(ValueError):
        G.topological_levels(ring, nodes(spark, "abcxy"), limit=10)


def test_components_of_a_long_path(spark):
    e = edges(spark, [(f"n{i:03d}", f"n{i + 1:03d}", 1) for i in range(60)] + [("z1", "z2", 1)])
    got = {r.id: r.component for r in G.components(nodes(spark, [f"n{i:03d}" for i in range(61)] + ["z1", "z2", "q"]), e).collect()}
    assert {got[f"n{i:03d}"] for i in range(61)} == {"n000"} and got["z2"] == "z1" and got["q"] == "q"


def test_modularity_of_two_triangles(spark):
    pairs = [("a", "b"), ("b", "c"), ("a", "c"), ("d", "e"), ("e", "f"), ("d", "f"), ("c", "d")]
    groups = spark.createDataFrame([(n, "x" if n in "abc" else "y") for n in "abcdef"], "id string, community string")
    assert G.modularity(nodes(spark, "abcdef"), edges(spark, [(a, b, 1) for a, b in pairs]), groups).first()[0] == pytest.approx(6 / 7 - 0.5)
    t = G.topology(nodes(spark, "abcdef"), edges(spark, [(a, b, 1) for a, b in pairs])).first()
    assert (t.nodes, t.edges, t.components) == (6, 7, 1) and t.clustering == pytest.approx((1 + 1 + 1 / 3 + 1 / 3 + 1 + 1) / 6)


def test_upserts_merge_and_remove(spark):
    old = spark.createDataFrame([("s", "a", "b", 0.5, "x"), ("s", "b", "c", 0.1, "y")], "layer string, src string, dst string, weight double, note string")
    new = spark.createDataFrame([("s", "a", "b", 0.9), ("s", "c", "d", 0.2)], "layer string, src string, dst string, weight double")
    assert sorted(map(tuple, G.upsert_edges(old, new).collect()), key=str) == [("s", "a", "b", 0.9, "x"), ("s", "b", "c", 0.1, "y"), ("s", "c", "d", 0.2, None)]
    assert G.remove_edges(old, new.select("src", "dst")).count() == 1
    states = spark.createDataFrame([("a", 1, "old"), ("b", 1, "old")], "id string, version int, v string")
    assert {r.id: r.v for r in G.upsert_nodes(states, spark.createDataFrame([("a", 2, "new")], "id string, version int, v string")).collect()} == {"a": "new", "b": "old"}


def test_archive_roundtrip_and_tampering(spark, tmp_path):
    papers = spark.createDataFrame([("a", "A", 1.5), ("b", "B", None)], "paper_id string, title string, rating double")
    links = spark.createDataFrame([("a", "b", 0.5), ("a", "L1C1", 1.0)], "src string, dst string, weight double")
    where = f"file://{tmp_path}/archive"
    exchange.export_archive({"papers": papers, "edges": links}, where)
    schemas = {"papers": "paper_id string, title string, rating double", "edges": "src string, dst string, weight double"}
    back = exchange.import_archive(spark, where, schemas)
    assert sorted(map(tuple, back["papers"].collect())) == sorted(map(tuple, papers.collect())) and back["edges"].count() == 1
    papers.limit(1).write.mode("append").json(f"{where}/papers")
    with pytest.raises(ValueError):
        exchange.import_archive(spark, where, schemas)


def test_capsule_checks_and_guarded_saving(spark, tmp_path):
    sound = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "idx int, embedding array<double>")
    links = spark.createDataFrame([(0, 1)], "src int, dst int")
    assert exchange.validate_capsule(sound, links, 2) == []
    bad = spark.createDataFrame([(0, [1.0, float("nan")]), (5, [0.0])], "idx int, embedding array<double>")
    assert len(exchange.validate_capsule(bad, spark.createDataFrame([(0, 9)], "src int, dst int"), 2)) == 3
    where = f"file://{tmp_path}/state"
    three = edges(spark, [("a", "b", 1), ("b", "c", 1), ("c", "d", 1)])
    assert exchange.save_guarded(three, where) and not exchange.save_guarded(three.limit(1), where)
    assert spark.read.parquet(f"{where}/current").count() == 3


def test_paths_of_the_largest_component(spark):
    e = edges(spark, [("a", "b", 1), ("c", "b", 1), ("c", "d", 1), ("x", "y", 1), ("d", "d", 1)])
    assert tuple(G.largest_paths(nodes(spark, "abcdxyz"), e).first()) == (4, pytest.approx(10 / 6), 3.0)
    assert tuple(G.largest_paths(nodes(spark, "ab"), edges(spark, [])).first()) == (1, 0.0, 0.0)
    assert G.largest_paths(nodes(spark, ""), e.limit(0)).count() == 0
