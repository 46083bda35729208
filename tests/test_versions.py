"""Versioned tables, the index kept by file state, streams into versions, and answers as of a time."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import clusters, store, versions
from quillspark.sources import files, index
from quillspark.streaming import ingest

ROWS = "project_id long, v string"


@pytest.fixture
def held(spark, tmp_path):
    v = versions.Versions(spark, str(tmp_path / "store"))
    v.commit({"t": spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], ROWS)})
    return v


def values(df):
    return sorted(r.v for r in df.collect())


def test_versions_add_replace_and_stay_readable(spark, held):
    before = held.read("t")
    held.commit({"t": spark.createDataFrame([(2, "B")], ROWS)}, {"t": spark.createDataFrame([(2,), (None,), (9,)], "project_id int")})
    held.commit({"t": spark.createDataFrame([(2, "C", 5)], f"{ROWS}, w int")})
    assert values(before) == values(held.read("t", 1)) == ["a", "b", "n"] and values(held.read("t", 2)) == ["B", "a"]
    assert sorted((r.v, r.w) for r in held.read("t").collect() if r.w) == [("C", 5)] and values(held.read("t")) == ["B", "C", "a"]
    held.commit(replaced={"t": spark.createDataFrame([(1,)], "project_id long")})
    assert values(held.read("t")) == ["B", "C"]
    assert {(r.version, r.n_rows) for r in held.history().where("n_rows is not null").collect()} == {(1, 3), (2, 1), (3, 1)}


def test_failed_write_and_conflict_change_nothing(spark, held):
    broken = spark.createDataFrame([(1, "x")], ROWS).withColumn("v", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        held.commit({"u": spark.createDataFrame([(1, "y")], ROWS), "t": broken}, {"t": spark.createDataFrame([(1,)], "project_id long")})
    assert held.version() == 1 and values(held.read("t")) == ["a", "b", "n"]
    with pytest.raises(ValueError):
        held.read("u")
    held.commit({"t": spark.createDataFrame([(3, "c")], ROWS)})
    with pytest.raises(versions.Conflict):
        held.commit({"t": spark.createDataFrame([(1, "late")], ROWS)}, base=1)
    with pytest.raises(Exception, match="v is string"):
        held.commit({"t": spark.createDataFrame([(1, 2)], "project_id long, v int")})
    assert values(held.read("t")) == ["a", "b", "c", "n"]


def test_a_taken_number_is_not_overwritten(spark, held):
    taken, late = held.manifest(), held.manifest() | {"operation": "late"}
    assert not held._switch(late) and held.manifest() == taken
    first, other = held, versions.Versions(spark, held.folder)
    step = first._switch
    first._switch = lambda m: (setattr(first, "_switch", step), other.commit({"t": spark.createDataFrame([(7, "other")], ROWS)}), step(m))[2]
    assert first.commit({"t": spark.createDataFrame([(8, "mine")], ROWS)}) == 3
    assert values(first.read("t")) == ["a", "b", "mine", "n", "other"]


def test_compact_expire_and_batches(spark, held):
    held.most_commits = 3
    for n in range(5):
        held.commit({"t": spark.createDataFrame([(5, f"x{n}")], ROWS)}, {"t": spark.createDataFrame([(5,)], "project_id long")}, batch=("q", n))
        held.commit({"t": spark.createDataFrame([(6, "again")], ROWS)}, batch=("q", n))
    assert values(held.read("t")) == ["a", "b", "n", "x4"] and len(held.manifest()["commits"]) <= 3
    now = values(held.read("t"))
    assert held.expire(keep=2, grace_seconds=3600) == [] and len(held.versions()) == 2
    assert held.expire(keep=1, grace_seconds=0) and values(held.read("t")) == now
    assert set(os.listdir(f"{held.folder}/data")) == {c["id"] for c in held.manifest()["commits"]}


def test_load_and_delete_projects(spark, tmp_path):
    v = versions.Versions(spark, str(tmp_path / "s"))
    jobs = lambda *p: spark.createDataFrame([(i, ["deep", "nets"], ["arxiv"], n, None, "2024-01-01 00:00:00") for i, n in p], "project_id int, keywords array<string>, databases array<string>, n_results int, failed_sources array<string>, completed_at string")
    papers = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "project_id int, title string")
    versions.load_projects(v, papers, jobs((1, 2), (2, 1)))
    versions.load_projects(v, papers.where("false"), jobs((1, 0)))
    assert [r.title for r in v.read("papers").collect()] == ["c"]
    assert sorted((r.project_id, r.query_text, r.keywords, r.n_results, r.failed_sources) for r in v.read("jobs").collect()) == [(1, "deep nets", '["deep","nets"]', 0, "[]"), (2, "deep nets", '["deep","nets"]', 1, "[]")]
    versions.delete_projects(v, spark.createDataFrame([(2,)], "project_id int"))
    assert v.read("papers").isEmpty() and [r.project_id for r in v.read("jobs").collect()] == [1] and v.read("papers", 2).count() == 1


HEAD = "id,title,abstract,authors,venue,year,n_citation,references,predicted_main_archetype,predicted_second_tier_archetype\n"


def uid(n):
    return f"00000000-0000-0000-0000-{n:012d}"


def test_index_follows_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()

    def put(name, *rows):
        (folder / name).write_text(HEAD + "".join(f"{uid(i)},{t},,[],,2000,1,\"{[uid(r) for r in refs]}\",,\n" for i, t, *refs in rows))

    def tables(store):
        t = index.index_tables(store)
        return sorted(map(tuple, t["cites"].collect())), sorted(map(tuple, t["titles"].collect())), sorted(r.id for r in t["meta"].collect())

    put("a.csv", (1, "One", 2, 3), (2, "Two"))
    put("b c.csv", (3, "one ", 1))
    v = versions.Versions(spark, str(tmp_path / "ix"), owner="file")
    assert len(index.update_index(v, str(folder))["parsed"]) == 2 and index.update_index(v, str(folder)) == {"parsed": [], "removed": []} and v.version() == 1
    assert dict(tables(v)[1])["one"] == uid(1)
    put("b c.csv", (3, "Three", 2), (4, "Four", 2))
    put("d.csv", (5, "Five", 1))
    got = index.update_index(v, str(folder))
    assert [f.rsplit("/", 1)[1] for f in got["parsed"]] == ["b%20c.csv", "d.csv"]
    changed = v.manifest()["commits"][-1]["id"]
    assert {r.file for r in spark.read.parquet(f"{v.folder}/data/{changed}/cites").collect()} == set(got["parsed"])
    (folder / "a.csv").unlink()
    assert index.update_index(v, str(folder))["removed"][0].endswith("a.csv")
    fresh = versions.Versions(spark, str(tmp_path / "full"), owner="file")
    index.update_index(fresh, str(folder))
    assert tables(v) == tables(fresh) and files.titles(index.index_tables(v)["meta"]).count() == 3


def test_index_is_sorted_in_pieces(spark, tmp_path, monkeypatch):
    """As many tasks sort the citations as their number calls for, not their bytes."""
    monkeypatch.setattr(index, "PIECE", 400)
    refs = lambda i: ", ".join(f"'{uid(j)}'" for j in range(i % 5))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(HEAD + "".join(f'{uid(i)},t,,[],,2000,1,"[{refs(i)}]",,\n' for i in range(40)))
    v = versions.Versions(spark, str(tmp_path / "ix"), owner="file")
    index.update_index(v, str(tmp_path / "in"))
    rows = spark.read.parquet(f"{v.folder}/data/{v.manifest()['commits'][0]['id']}/cites").withColumn("of", F.input_file_name()).collect()
    assert len(rows) == sum(i % 5 for i in range(40)) and len({r.of for r in rows}) > 4 and len({(r.src, r.of) for r in rows}) == len({r.src for r in rows})


def test_stream_into_versions_restarts_without_repeats(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    put = lambda n, *items: (landing / f"{n}.json").write_text("\n".join(map(json.dumps, items)))
    v = versions.Versions(spark, str(tmp_path / "store"))
    sink = ingest.into_versions(v, "crossref", lambda: F.lit(7).cast("long"))
    batches = []

    def recorded(batch, n):
        sink(batch, n)
        batches.append(n)

    def run():
        rows = ingest.prepared(ingest.landed(spark, "crossref", str(landing)))
        rows.writeStream.foreachBatch(recorded).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()

    put(1, {"DOI": "10.1/a", "title": ["T"]}, {"DOI": "10.1/a", "title": ["T"]})
    run()
    put(2, {"DOI": "10.1/a", "title": ["T"], "published": {"date-parts": [[2004]]}}, {"DOI": "10.1/b", "title": ["U"]})
    run()
    # As after a crash between the commit and the end of the batch: it runs again.
    (tmp_path / "ck" / "commits" / "1").unlink()
    (tmp_path / "ck" / "commits" / ".1.crc").unlink(missing_ok=True)
    run()
    assert batches == [0, 1, 1] and v.version() == 2
    assert {r.title: r.year for r in v.read("papers").collect()} == {"T": 2004, "U": None}
    assert sorted((r.batch, r.source, r.n) for r in v.read("arrivals").collect()) == [(0, "__all__", 2), (0, "crossref", 2), (1, "__all__", 2), (1, "crossref", 2)]


@pytest.mark.parametrize("slice_seconds", [50, 1000, 10**6])
def test_answers_as_of(spark, slice_seconds):
    rng = random.Random(3)
    log = [(rng.choice(["a", "b", None]), rng.choice([None, *range(0, 3000, 7)]), rng.choice([None, 1, 2, 3]), rng.random() < 0.6) for _ in range(300)]
    asked = [(i, rng.choice(["a", "b", "c", None]), rng.choice([None, *range(0, 3000, 5)])) for i in range(200)]
    at = F.timestamp_seconds("at")
    got = store.answered(spark.createDataFrame(asked, "id int, k string, at long").withColumn("at", at), spark.createDataFrame(log, "k string, at long, value int, ok boolean").withColumn("at", at), "k", "at", slice_seconds=slice_seconds)
    want = {}
    for i, k, t in asked:
        found = [(a, v) for q, a, v, ok in log if ok and v is not None and None not in (k, t, a) and q == k and a <= t]
        a, v = max(found, default=(None, None))
        want[i] = (v, "none" if v is None else "fresh" if t - a < 300 else "stale")
    assert {r.id: (r.value, r.state) for r in got.collect()} == want


def test_meta_graph_and_scope(spark):
    levels = spark.createDataFrame([(0, 0, 0, False), (0, 1, 0, False), (0, 2, 2, False), (0, 3, 3, True), (1, 0, 0, False), (1, 1, 0, False), (1, 2, 0, False), (1, 3, 3, True)], "level int, node long, community long, is_misc boolean")
    nodes = spark.createDataFrame([(i, f"a title of more than 22 signs {i}" if i else "short", float(i), 0.0, float(i)) for i in range(4)], "node long, title string, x double, y double, score double")
    edges = spark.createDataFrame([(0, 2), (2, 1), (0, 1)], "source long, target long")
    show = lambda level: sorted((r.kind, r.a, r.b or -1, r.n, r.label or "") for r in clusters.meta_graph(levels, nodes, edges, level).collect())
    assert show(0) == [("cluster", 0, -1, 2, "Cluster 0 · 2"), ("cluster", 2, -1, 1, "Cluster 2 · 1"), ("cluster", 3, -1, 1, "Miscellaneous · 1"), ("link", 0, 2, 2, "")]
    assert [r for r in show(None) if r[0] == "paper"][1] == ("paper", 1, -1, 1, "a title of more than...") and len(show(None)) == 7
    assert sorted(r.node for r in clusters.scope(levels, nodes, 0).collect()) == [0, 1, 2] and clusters.scope(levels, nodes).count() == 4
    assert sorted((r.community, r.node, r.first) for r in clusters.seeds(levels, nodes).collect()) == [(0, 2, 0), (3, 3, 3)]
    assert sorted(map(tuple, clusters.misc_clusters(levels).collect())) == [(0, 3), (1, 3)]
