"""Steps that take all groups at once, against plain sequences: predecessors over ranges, forests, authors, parallel Louvain, titles by grams, numbered rows."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import community, listings, resolve, traverse
from quillspark.operators.components import connected_components


@pytest.fixture()
def split(spark):
    """Shuffled data stays in many partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_last_before_of_a_hot_key(spark, split):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 9 + ["a", "b", None]), i, i if rng.random() < 0.7 else None) for i in range(3000)]
    seen, want = {}, {}
    for k, i, v in rows:
        want[i] = seen.get(k)
        if v is not None:
            seen[k] = v
    got = resolve.last_before(spark.createDataFrame(rows, "k string, at long, v long").repartition(5), ["k"], "at", "v").collect()
    assert {r.at: r.before for r in got if r.k is not None} == {i: want[i] for k, i, _ in rows if k is not None} and len(got) == len(rows)


def test_roots_of_a_long_way(spark):
    led = [(i, i - 1) for i in range(1, 200)] + [(1000 + i, 1000) for i in range(1, 50)]
    got = {r.ord: r.root for r in resolve.roots(spark.createDataFrame(led, "ord long, leader long")).collect()}
    assert got == {i: 0 for i in range(1, 200)} | {1000 + i: 1000 for i in range(1, 50)}


def test_stars_and_others(spark):
    edges = [(0, 9), (9, 4), (20, 21), (22, 20), (30, 31), (31, 30), (40, 40), (50, 51), (51, 51), (60, 70), (61, 70), (None, 1)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {0: 0, 9: 0, 4: 0, 20: 20, 21: 20, 22: 20, 30: 30, 31: 30, 40: 40, 50: 50, 51: 50, 60: 60, 61: 60, 70: 60}


@pytest.mark.parametrize("seed", range(2))
def test_first_apart_follows_the_sequence(spark, seed):
    rng = random.Random(seed)
    rows = sorted({(rng.choice("abcdefgh"), rng.choice([None, *"123456789"])): i for i in range(90)}.items(), key=lambda r: r[1])
    names, ids, want = set(), set(), []
    for (name, oa), i in rows:
        if name not in names and (oa is None or oa not in ids):
            names.add(name)
            ids.add(oa)
            want.append(i)
    table = spark.createDataFrame([(i, name, oa) for (name, oa), i in rows], "ord long, name string, oa string")
    assert sorted(r.ord for r in listings.first_apart(table).collect()) == want
    assert listings.first_apart(table.where("false")).count() == 0


def test_parallel_louvain(spark):
    rng = random.Random(4)
    ring = [(0, 5 * c + a, 5 * c + b, 1.0) for c in range(6) for a, b in itertools.combinations(range(5), 2)] + [(0, 5 * c, (5 * c + 7) % 30, 1.0) for c in range(6)]
    planted = [(1, a, b, 1.0) for a, b in itertools.combinations(range(60), 2) if rng.random() < (0.5 if a // 15 == b // 15 else 0.03)]
    edges = spark.createDataFrame([(g, a, b, w, i) for i, (g, a, b, w) in enumerate([*ring, *planted, (1, 3, 3, 9.0)])], "graph_id int, source long, target long, weight double, ord long")
    nodes = spark.createDataFrame([(0, i) for i in range(32)] + [(1, i) for i in range(60)] + [(2, i) for i in range(3)], "graph_id int, idx long")
    levels = community.louvain_parallel(nodes, edges).cache()
    first = {r.node: r.community for r in levels.where("graph_id = 0 AND level = 0").collect()}
    assert all(len({first[5 * c + i] for i in range(5)}) == 1 for c in range(6)) and first[30] == first[31] == 30
    assert {r.is_misc for r in levels.where("graph_id = 2").collect()} == {True} and levels.where("graph_id = 2").select("community").distinct().count() == 1
    assert {r.nested for r in community.nested(levels).collect()} == {True}
    of = lambda x: {r.graph_id: r.modularity for r in community.modularity(edges.withColumn("graph_id", F.col("graph_id").cast(x.schema["graph_id"].dataType)), community.at_level(x, 99), textbook=True).collect()}
    mine, plain = of(levels), of(community.louvain(nodes.where("graph_id < 2").withColumn("graph_id", F.col("graph_id").cast("string")), edges.withColumn("graph_id", F.col("graph_id").cast("string"))))
    assert all(mine[g] >= 0.98 * plain[str(g)] for g in (0, 1))
    assert community.louvain_parallel(nodes.where("false"), edges.where("false")).count() == 0


def test_moves_of_many_nodes_send_no_table_to_the_driver(spark, tmp_path):
    """Tables of a level with many nodes are joined in partitions, though they are far below Spark's threshold; the step is the same as with broadcasts."""
    pairs = [(5 * c + a, 5 * c + b) for c in range(4) for a, b in itertools.permutations(range(5), 2)]
    spark.createDataFrame([("g", a, b, 1.0) for a, b in pairs], "graph_id string, a long, b long, w double").write.parquet(f"{tmp_path}/links")
    spark.createDataFrame([("g", i, 4.0, 0.0, i, 80.0) for i in range(20)], "graph_id string, node long, k double, inner double, label long, m2 double").write.parquet(f"{tmp_path}/nodes")
    links, nodes = (spark.read.parquet(f"{tmp_path}/{x}") for x in ("links", "nodes"))
    many, few = (community.moved_half(links, nodes, 1.0, 0, x) for x in (False, True))
    assert "Broadcast" not in many._jdf.queryExecution().executedPlan().toString()
    got = {r.node: r.label for r in many.collect()}
    assert got == {r.node: r.label for r in few.collect()} and len(set(got.values())) < 20


def test_titles_by_grams(spark):
    titles = ["Deep nets", "deep networks for all", "On joins", "éa", "x", "", None, "deep deep nets"]
    meta = spark.createDataFrame([(str(i), t, i % 3, i) for i, t in enumerate(titles)], "id string, title string, n_citation long, ord long")
    asked = ["deep", "DEEP NETS", "n", "éa", "zz", "deep nets ", "ep net", "x", "joins", "", "0"]
    got = {r.query: r.id for r in traverse.resolve_seeds(meta, spark.createDataFrame([(a,) for a in asked], "query string")).collect()}
    want = {}
    for a in asked:
        low = a.strip().lower()
        if not low:
            continue
        exact = [i for i, t in enumerate(titles) if (t or "").strip().lower() == low]
        part = sorted((-(i % 3), i) for i, t in enumerate(titles) if low in (t or "").lower())
        if a.strip().isdigit():
            want[a] = a
        elif exact or part:
            want[a] = str(exact[0] if exact else part[0][1])
    assert got == want
    plan = traverse.resolve_seeds(meta, spark.createDataFrame([("deep",)], "query string"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_numbered_and_scored(spark, split):
    rng = random.Random(2)
    scores = [(f"p{i}", rng.choice([1.0, 2.0, 2.5, None])) for i in range(400)] + [("p3", 9.0), (None, 3.0), ("gone", 1.0)]
    papers = spark.createDataFrame([(f"p{i}", [f"a{i}"], f"t{i}") for i in range(400)], "id string, authors array<string>, title string")
    best = {}
    for i, s in scores:
        if i in {f"p{n}" for n in range(400)}:
            best[i] = max((x for x in (best.get(i), s) if x is not None), default=None)
    order = sorted(best, key=lambda i: (best[i] is None, -(best[i] or 0), i))
    got = sorted(listings.scored_papers(papers, spark.createDataFrame(scores, "id string, score double").repartition(6)).collect())
    assert [(r.place, r.id, r.score, r.authors) for r in got] == [(n, i, best[i], [f"a{i[1:]}"]) for n, i in enumerate(order, 1)]


def test_children_in_order(spark):
    parents = spark.createDataFrame([(1, "x"), (2, "y")], "id long, name string")
    kids = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 1, "a"), (3, 1, "z")], "id long, place int, v string")
    rows = {r.id: r for r in listings.with_children(parents, "id", kids=(kids, [F.col("place")]), none=(kids.where("false"), [F.col("v")])).collect()}
    assert [(k.place, k.v) for k in rows[1].kids] == [(1, "a"), (1, "a"), (2, "b")] and rows[2].kids == [] and rows[1].none == []


@pytest.mark.parametrize("fits", [0, 40, 1 << 20])
def test_graphs_that_fit_a_task_are_finished_there(spark, fits):
    """In rounds, in rounds until a graph fits, or in one task: every level is nested, gains, and finds the planted groups; graphs that fit cost a few jobs, not some for every half sweep."""
    rng = random.Random(5)
    rings = [("r", 5 * c + a, 5 * c + b, 1.0) for c in range(6) for a, b in itertools.combinations(range(5), 2)] + [("r", 5 * c, (5 * c + 5) % 30, 1.0) for c in range(6)]
    apart = [("s", 3 * c + a, 3 * c + b, 1.0) for c in range(4) for a, b in itertools.combinations(range(3), 2)]
    noise = [("t", a, b, 1.0 + (a + b) % 2) for a, b in itertools.combinations(range(40), 2) if rng.random() < 0.1]
    edges = spark.createDataFrame([(g, a, b, w, i) for i, (g, a, b, w) in enumerate([*rings, *apart, *noise])], "graph_id string, source int, target int, weight double, ord long").localCheckpoint()
    nodes = spark.createDataFrame([("r", i) for i in range(32)] + [("s", i) for i in range(12)] + [("t", i) for i in range(40)] + [("u", 0), ("u", 1), (None, 0)], "graph_id string, idx int").localCheckpoint()
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    before = jobs()
    paths = community.louvain_paths(nodes, edges, fits=fits)
    spent = jobs() - before
    at = {(r.graph_id, r.node): r.path for r in paths.collect()}
    assert len(at) == nodes.count() and {len(p) for (g, _), p in at.items() if g in ("u", None)} == {1}
    assert all(len({len(p) for (h, _), p in at.items() if h == g}) == 1 for g in "rstu")
    assert all(at["r", 5 * c + i][0] == 5 * c for c in range(6) for i in range(5)) and at["r", 30] == at["r", 31] == [30] * len(at["r", 0])
    assert [at["s", i] for i in range(12)] == [[i // 3 * 3] for i in range(12)] and at["u", 1] == [0]
    assert {(r.graph_id, r.nested) for r in community.nested_paths(paths).collect()} == {(g, True) for g in ("r", "s", "t", "u", None)}
    q = {}
    for r in community.modularities(paths, edges).collect():
        q.setdefault(r.graph_id, {})[r.level] = r.modularity
    assert set(q) == {"r", "s", "t"} and all(v[i] <= v[i + 1] + 1e-9 for v in q.values() for i in range(len(v) - 1))
    levels = paths.select("graph_id", "node", F.posexplode("path").alias("level", "community"))
    for n in range(2):
        want = community.modularity(edges, community.at_level(levels.withColumn("is_misc", F.lit(False)), n), textbook=True).collect()
        assert {r.graph_id: pytest.approx(r.modularity) for r in want} == {g: v[min(n, max(v))] for g, v in q.items()}
    assert fits < 1 << 20 or spent < 60


def test_a_broken_path_is_not_nested(spark):
    paths = spark.createDataFrame([("a", 0, [0, 0]), ("a", 1, [0, 1]), ("b", 0, [0, 0]), ("b", 1, [1, 0]), ("c", 0, [0])], "graph_id string, node long, path array<long>")
    assert {r.graph_id: r.nested for r in community.nested_paths(paths).collect()} == {"a": False, "b": True, "c": True}
