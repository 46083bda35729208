"""Traversal on the small citation graph; communities, modularity and lanes on small graphs."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import clusters, community, traverse
from quillspark.operators.components import connected_components

META = [("seed", "A digital watermark", 1359), ("A", "Alpha", 10), ("B", "Beta", 5), ("C", "Gamma", 3), ("D", "Delta", 2), ("E", "Epsilon", 1), ("dup", "duplicate title", 9), ("dup2", "duplicate title", 99)]
CITES = [("seed", "A", 0), ("seed", "B", 1), ("seed", "Z", 2), ("A", "E", 0), ("C", "seed", 0), ("D", "seed", 0)]


@pytest.fixture(scope="module")
def graph(spark):
    meta = spark.createDataFrame([(i, t, f"Abstract for {t}", c, n) for n, (i, t, c) in enumerate(META)], "id string, title string, abstract string, n_citation long, ord long")
    return spark.createDataFrame(CITES, "src string, dst string, pos long"), meta, spark.createDataFrame([("seed",)], "id string")


def nodes_of(found):
    return {r.id for r in found[0].collect()}


@pytest.mark.parametrize(("how", "want"), [
    ({"hops": 1}, {"seed", "A", "B", "C", "D"}), ({"hops": 2}, {"seed", "A", "B", "C", "D", "E"}), ({"hops": 1, "cap": 1}, {"seed", "A", "C"}), ({"hops": 1, "direction": "past"}, {"seed", "A", "B"}),
    ({"hops": 1, "direction": "future"}, {"seed", "C", "D"}), ({"hops": 1, "direction": "past", "keywords": ["alpha"]}, {"seed", "A"}), ({"hops": 1, "direction": "sideways"}, {"seed"}),
])
def test_explore(graph, how, want):
    assert nodes_of(traverse.explore(*graph, **how)) == want


def test_edges_and_counts(graph):
    edges = {(r.src, r.dst) for r in traverse.explore(*graph, hops=1)[1].collect()}
    assert edges == {("seed", "A"), ("seed", "B"), ("C", "seed"), ("D", "seed")}
    assert {r.id: r.reference_count for r in traverse.reference_counts(graph[0]).collect()}["seed"] == 3


def test_seeds(spark, graph):
    wanted = spark.createDataFrame([("seed",), ("a DIGITAL watermark",), ("duplicate",), ("duplicate title",), ("nothing",)], "query string")
    got = {r.query: r.id for r in traverse.resolve_seeds(graph[1], wanted).collect()}
    assert got == {"seed": "seed", "a DIGITAL watermark": "seed", "duplicate": "dup2", "duplicate title": "dup"}


def run_louvain(spark, n, edges, **how):
    nodes = spark.createDataFrame([("g", i) for i in range(n)], "graph_id string, idx long")
    rows = spark.createDataFrame([("g", a, b, 1.0, k) for k, (a, b) in enumerate(edges)], "graph_id string, source long, target long, weight double, ord long")
    return community.louvain(nodes, rows, **how), rows


def test_louvain_shapes(spark):
    clique = lambda s: [(s + i, s + j) for i in range(3) for j in range(i)]
    levels, edges = run_louvain(spark, 6, clique(0) + clique(3) + [(2, 3)])
    at = {r.node: r.community for r in community.at_level(levels, 9).collect()}
    assert len({at[i] for i in (0, 1, 2)}) == 1 and len({at[i] for i in (3, 4, 5)}) == 1 and at[0] != at[3]
    q = [community.modularity(edges, community.at_level(levels, 9), g).first().modularity for g in (0.5, 1, 2)]
    assert q[0] > q[1] > q[2] and q[1] > 0.2
    levels, _ = run_louvain(spark, 6, clique(0))
    rows = community.at_level(levels, 0).collect()
    assert len({r.community for r in rows if r.node > 2}) == 1 and all(r.is_misc == (r.node > 2) for r in rows)
    levels, _ = run_louvain(spark, 3, [])
    assert {(r.community, r.is_misc) for r in levels.collect()} == {(0, True)}
    chain = [e for t in range(8) for e in clique(3 * t)] + [(3 * t + 2, 3 * t + 3) for t in range(7)]
    levels, _ = run_louvain(spark, 24, chain)
    sizes = [r.n for r in levels.groupBy("level").agg(F.countDistinct("community").alias("n")).orderBy("level").collect()]
    assert len(sizes) >= 2 and sizes == sorted(sizes, reverse=True) and sizes[0] > sizes[-1]
    assert run_louvain(spark, 24, chain, max_levels=1)[0].select("level").distinct().count() == 1


def test_textbook_modularity(spark):
    rng = random.Random(1)
    edges = {tuple(sorted((rng.randrange(12), rng.randrange(12)))) for _ in range(30)}
    edges = [(a, b) for a, b in edges if a != b]
    c = [rng.randrange(3) for _ in range(12)]
    k = [sum(i in e for e in edges) for i in range(12)]
    m2 = 2 * len(edges)
    want = sum((2 if (i, j) in edges or (j, i) in edges else 0) / 2 - k[i] * k[j] / m2 for i in range(12) for j in range(12) if c[i] == c[j] and i != j) / m2 - sum(x * x for x in k) / m2**2
    _, rows = run_louvain(spark, 12, edges)
    at = spark.createDataFrame([("g", i, x) for i, x in enumerate(c)], "graph_id string, node long, community long")
    assert community.modularity(rows, at, textbook=True).first().modularity == pytest.approx(want)


def test_lanes(spark):
    sizes = spark.createDataFrame([("g", 0, 5, False), ("g", 1, 4, False), ("g", 2, 9, False), ("g", 3, 50, True), ("g", 4, 1, False)], "graph_id string, community long, size long, is_misc boolean")
    weights = spark.createDataFrame([("g", 0, 1, 3), ("g", 1, 2, 1)], "graph_id string, a long, b long, n long")
    order = [r.community for r in community.lanes(sizes, weights).orderBy("lane").collect()]
    assert order[-2:] == [4, 3] and sorted(order[:3]) == [0, 1, 2]


def test_year_queue_fixture(spark):
    nodes = spark.createDataFrame([(0, 2020, 9.0), (1, 2020, 5.0), (2, 2021, 7.0), (3, 2020, 8.0), (4, 2020, 3.0), (5, 2019, 6.0)], "node long, year int, score double")
    levels = spark.createDataFrame([(0, i, c) for i, c in enumerate([0, 0, 1, 2, 2, 3])] + [(1, i, c) for i, c in enumerate([10, 10, 10, 11, 11, 11])], "level int, node long, community long")
    none = nodes.where("node < 0")
    lane = levels.where("level = 1")
    queues = lambda placed, year: [(r.lane, r.node) for r in clusters.year_queues(levels, nodes, lane, placed, year).orderBy("lane", "place").collect()]
    assert queues(none, 2020) == [(10, 0), (10, 1), (11, 3), (11, 4)]
    assert queues(nodes.where("node = 0"), 2020)[0] == (10, 1) and queues(none, 1990) == []
    found = {(r.node, r.level) for r in clusters.siblings(levels, nodes, nodes.where("node = 0"), 1).collect()}
    assert found == {(2, 1)}
    assert {r.year for r in clusters.expandable_years(nodes, nodes.where("year = 2020")).collect()} == {2019, 2021}


def test_reindexed(spark):
    nodes = spark.createDataFrame([(x,) for x in "dbca"], "id string")
    edges = spark.createDataFrame([("a", "c"), ("a", "z")], "src string, dst string")
    n, e = traverse.reindexed(nodes, edges)
    assert {r.id: r.idx for r in n.collect()} == {"a": 0, "b": 1, "c": 2, "d": 3} and [tuple(r) for r in e.collect()] == [(0, 2)]


def test_components_leave_no_growing_estimate(spark):
    """Estimates of sizes that rounds multiply have thousands of bits after a few rounds of a long path."""
    edges = spark.range(300).selectExpr("id AS src", "id + 1 AS dst")
    found = connected_components(edges)
    assert found.agg({"component": "max"}).first()[0] == 0 and found.count() == 301
    assert found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 64


def test_pairs_told_apart_in_pieces(spark):
    rows = spark.range(3000).selectExpr("id % 50 AS src", "id % 7 AS dst")
    got = traverse.undirected(rows, 9)
    assert got.rdd.getNumPartitions() == 9
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, traverse.undirected(rows).collect())) == sorted({(min(i % 50, i % 7), max(i % 50, i % 7)) for i in range(3000) if i % 50 != i % 7})


def test_modularity_adds_parallel_edges_of_a_community_only(spark):
    """Edges between communities are gone before pairs are grouped, which is what grows with the edges."""
    edges = spark.createDataFrame([(0, 0, 1, 1.0), (0, 1, 0, 2.0), (0, 1, 2, 1.0), (0, 2, 3, 1.0), (0, 3, 3, 5.0)], "graph_id int, source long, target long, weight double")
    at = spark.createDataFrame([(0, 0, 7), (0, 1, 7), (0, 2, 8), (0, 3, 8)], "graph_id int, node long, community long")
    found = community.modularity(edges, at, 0.5)
    m2, k = 10.0, [3.0, 4.0, 2.0, 1.0]
    assert found.first().modularity == pytest.approx(2 * (3 - 0.5 * k[0] * k[1] / m2) / m2 + 2 * (1 - 0.5 * k[2] * k[3] / m2) / m2)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    grouped = next(i for i, line in enumerate(plan.splitlines()) if "Aggregate [graph_id" in line and "AS kk" in line)
    assert any("= c" in line or "ca" in line for line in plan.splitlines()[grouped + 1 : grouped + 4])


def test_brand_graphs_link_parts_of_one_order(spark, tmp_path):
    """Parts are linked where one order holds both or one cites the other: once, inside a brand only, and not by an order without a key."""
    from quillspark.plans import catalog

    brands = ["A", "A", "A", "A", "B", "B", "B", "B"]
    spark.createDataFrame([(i, f"part {i}", b, "t", 1) for i, b in enumerate(brands)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    held = {16: [0, 1, 3, 4, 1], 24: [1, 0], 18: [1], 23: [4, 6], None: [5, 6, 2, 3]}
    spark.createDataFrame([(o, p) for o, parts in held.items() for p in parts], "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    nodes, edges = catalog.brand_graphs(spark, str(tmp_path))
    at = {(r.graph_id, r.idx): r.id for r in nodes.collect()}
    found = [(at[r.graph_id, r.source], at[r.graph_id, r.target]) for r in edges.collect()]
    # 16 % 8 and 24 % 8 are part 0, 18 % 8 is part 2, 23 % 8 part 7.
    assert sorted(found) == [(0, 1), (0, 3), (1, 2), (1, 3), (4, 6), (4, 7), (6, 7)]
