"""Operators that no registered query runs, on small tables."""

from __future__ import annotations

import datetime
import json

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quillspark.functions import answers
from quillspark.operators import clusters, dashboard, filters, keywords, listings, models, resolve, store, traverse
from quillspark.schemas import PAPER
from quillspark.sources import files
from quillspark.sources.normalize import as_papers
from quillspark.streaming import ingest


def rows_of(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=str)


JSON = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=6), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=4), x, max_size=3), max_leaves=8)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab {}[]\\\\\"", max_size=12), JSON, st.sampled_from(["", " done", "\n```"]))
def test_last_value_is_the_last_one_that_opens(before, value, after):
    text = before.replace("{", "").replace("[", "").replace('"', "") + json.dumps(value) + after
    got = answers.last_value(text, "{", lambda x: isinstance(x, dict))
    decoder, want = json.JSONDecoder(), None
    for at, c in enumerate(text):
        if c == "{":
            try:
                found = decoder.raw_decode(text, at)[0]
                want = found if isinstance(found, dict) else want
            except ValueError:
                pass
    assert got == want


@pytest.mark.parametrize(("answer", "want"), [
    ('* "Title": "Caf\\u00e9 \\"x\\"" and\n"summary" = "One\\ntwo"', ('Café "x"', "One\ntwo")), ("**Title: no\nTitle:  \nReal one\n> Summary: \'S\'", ("Real one", "S")),
    ('{"title": "T"} {"title": "U", "summary": ""} Summary: s', ("U", "")), (None, ("", "")), ('{"summary": 5}', ("", "5")), ('title: "a" then TITLE: "b"', ("b", "")),
])
def test_fields_of_prose(answer, want):
    assert answers.summary_of(answer) == want


def test_keywords_of_answers():
    assert answers.keywords_of(json.dumps([f"k{i}" for i in range(20)])) == [f"k{i}" for i in range(12)]
    assert answers.keywords_of('[["a"], "b"]') == ["[\'a\']", "b"] and answers.keywords_of("[] [ ]") == []
    assert answers.label_of('{"main_archetype": "x"}') == ("x", None, None) and answers.label_of("[1]")[2] and answers.label_of('{"main_archetype": "x", "second_tier_archetype": 3}')[2]


def test_files_by_suffix(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q"'), (2, "b, c")], "id int, t string")
    for kind in ("csv", "json", "jsonl", "parquet"):
        path = f"{tmp_path}/x.{kind}"
        files.write_any(df, path)
        assert rows_of(files.read_any(spark, path, "id int, t string")) == [(1, 'a "q"'), (2, "b, c")]
    with pytest.raises(ValueError):
        files.read_any(spark, "x.doc")


def test_store_parts(spark):
    df = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    assert rows_of(store.valid_projects(df([(1, " a "), (2, " "), (3, None)], "id int, name string"))) == [(1, "a")]
    held = df([("a",), ("b",)], "k string")
    assert rows_of(store.contains(held, df([("a",), ("c",)], "k string"), ["k"])) == [("a", True), ("c", False)]
    assert rows_of(store.remaining(df([(1,), (2,), (3,)], "i int"), df([(1, "x"), (2, " ")], "i int, l string"), "i", "l")) == [(2,), (3,)]
    nodes, links = store.without_node(df([(1,), (2,), (3,)], "node int"), df([(1, 2), (2, 3), (1, 3)], "src int, dst int"), df([(2,)], "node int"))
    assert rows_of(nodes) == [(1,), (3,)] and rows_of(links) == [(1, 3)]
    assert rows_of(store.after_first(held, df([("a",)], "k string"), "k")) == [("b",)]
    at = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    assert rows_of(store.fresh(df([(1, at(1)), (2, at(50))], "i int, at timestamp_ntz"), "at", F.lit(at(55)), 30), "i") == [(2,)]
    assert rows_of(dashboard.in_last(df([(1, datetime.datetime(2024, 1, d)) for d in (1, 5, 9)], "i int, at timestamp_ntz"), "at", F.lit(datetime.datetime(2024, 1, 9)), 4)) == [(2,)]
    assert rows_of(filters.bar_widths(df([("a", 200), ("b", 1)], "k string, n int"), "n"), "k", "width") == [("a", 100), ("b", 2)]


def test_model_parts(spark):
    df = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    labels = df([(1, "A", " "), (2, None, "x"), (3, "B", "y")], "row_index int, main_archetype string, second_tier_archetype string")
    assert rows_of(models.prepared(df([(1,), (2,), (3,), (4,)], "row_index int"), labels)) == [(1, "A", "None"), (3, "B", "y")]
    parts = models.stratified(df([(i, "ab"[i % 2]) for i in range(400)] + [(999, "c")], "i int, l string"), "l", "i", 0.25)
    held = {r["l"]: r["count"] for r in parts.where("held_out").groupBy("l").count().collect()}
    assert set(held) == {"a", "b"} and all(25 < n < 75 for n in held.values())
    assert rows_of(models.encoded_labels(df([("b",), ("None",), ("?",), (None,)], "l string"), "l", ["a", "b", "None"]), "l", "l_id") == sorted([("b", 1), ("None", 2), ("?", 2), (None, 2)], key=str)
    p = as_papers(df([("t1", "A"), ("t2", None)], "t string, m string"), "x", title=F.col("t"), predicted_main_archetype=F.col("m"))
    fixed = models.patched(p, df([("t2", "B", "S")], "key string, main string, second string"), F.col("title"))
    assert rows_of(fixed, "title", "predicted_main_archetype", "predicted_second_tier_archetype") == [("t1", "A", None), ("t2", "B", "S")]
    items = models.classified_items(df([(1, "x"), (2, " "), (3, None)], "id int, abstract string"), {"main": df([(1, "A", 0.5), (2, "B", 0.9)], "id int, label string, confidence double")})
    assert rows_of(items, "id", "main", "main_confidence") == [(1, "A", 0.5), (2, None, 0.0), (3, None, 0.0)]


def test_enrichment_with_stars(spark):
    p = as_papers(
        spark.createDataFrame([("a", None, "see https://github.com/o/r.git for code", None), ("b", "https://gitlab.com/g/s", "x", False), ("c", "", "our dataset is available", None)], "t string, u string, a string, h boolean"),
        "x", title=F.col("t"), code_url=F.col("u"), abstract=F.col("a"), has_public_code=F.col("h"),
    )
    stars = spark.createDataFrame([("https://github.com/o/r", 7), ("https://github.com/o/r", 7)], "url string, stars long")
    got = {r.title: (r.code_url, r.has_public_code, r.repo_stars, r.has_dataset) for r in models.enriched(p, stars).collect()}
    assert got == {"a": ("https://github.com/o/r", True, 7, False), "b": ("https://gitlab.com/g/s", True, 0, False), "c": (None, False, 0, True)}


def test_cluster_parts(spark):
    df = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    at = df([(0, 5), (1, 5), (2, 9)], "node int, community int")
    assert rows_of(clusters.centroids(at, df([(0, 0.0, 0.0), (1, 2.0, 4.0), (2, 1.0, 1.0)], "node int, x double, y double")), "community", "x", "y") == [(5, 1.0, 2.0), (9, 1.0, 1.0)]
    assert rows_of(clusters.year_dividers(df([(1, 0.0), (2, 4.0), (3, 6.0)], "year int, x double"))) == [(1, 2.0), (2, 5.0), (3, None)]
    assert rows_of(clusters.renumbered(df([(0, 9), (1, 3), (2, 9)], "node int, community int"))) == [(0, 0), (1, 1), (2, 0)]
    assert [r.x for r in df([(1,), (26,), (27,)], "n int").select(clusters.letters(F.col("n")).alias("x")).collect()] == ["A", "Z", "27"]
    assert rows_of(clusters.split_by_time(df([(1, 1990), (2, 2000), (3, None)], "i int, year int"), F.lit(2000)), "i", "side") == [(1, "past"), (2, "future"), (3, "future")]
    papers = F.array(F.struct(F.lit("T").alias("title"), F.lit(None).cast("string").alias("abstract"), F.array(F.lit("A"), F.lit("")).alias("archetypes")))
    children = F.array(F.struct(F.lit("").alias("title"), F.lit("s").alias("summary")))
    told = spark.range(1).select(clusters.finest_prompt(papers, F.lit("C")).alias("a"), clusters.higher_prompt(children, F.lit(None).cast("string")).alias("b")).first()
    assert told.a == "Cluster label: C\nPapers in this cluster (1):\n1. Title: T\n   Archetypes: A\n   Abstract: n/a" and told.b == "Finer sub-cluster summaries (1):\n1. Untitled — s"


def test_seed_or_raw(spark):
    meta = spark.createDataFrame([("i1", "Deep nets", 3, 0)], "id string, title string, n_citation long, ord long")
    got = traverse.seed_or_raw(meta, spark.createDataFrame([("abc",), ("deep NETS",), ("no such title",)], "query string"))
    assert rows_of(got) == [("abc", "abc"), ("deep NETS", "i1"), ("no such title", "no such title")]


def test_filter_toggle(spark):
    nodes = spark.createDataFrame([("s", "x", ""), ("a", "graph", ""), ("b", "y", "")], "id string, title string, abstract string")
    edges = spark.createDataFrame([("s", "a"), ("a", "b"), ("b", "s")], "src string, dst string")
    kept, inner = traverse.filtered_graph(nodes, edges, F.lit("s"), ["graph"])
    assert rows_of(kept, "id") == [("a",), ("s",)] and rows_of(inner) == [("s", "a")]
    for how in ({"on": False}, {"prefiltered": True}, {"keywords": []}):
        assert traverse.filtered_graph(nodes, edges, F.lit("s"), **({"keywords": ["graph"]} | how))[1].count() == 3
    assert spark.range(1).select(traverse.settings_from_json(F.lit('{"hops": 4}')).alias("s")).first().s.asDict() == {"hops": 4, "most_per_hop": None, "resolution": 0.5}
    assert spark.range(1).select(traverse.settings_from_json(F.lit("broken")).alias("s")).first().s.hops == 2


def sequence(stored, rows):
    authors, out = [list(a) for a in stored], {}
    for ord_, name, oa in rows:
        found = next((a for a in authors if oa and a[2] == oa), None) or next((a for a in authors if a[1] == name), None)
        if found is None:
            authors.append(found := [f"new:{ord_}", name, oa])
        out[ord_] = found[0]
    return out


def test_matched_authors_follow_the_sequence(spark):
    import random

    rng = random.Random(3)
    stored = [("1", "n0", "o0"), ("2", "n1", None)]
    rows = [(i, f"n{rng.randrange(9)}", rng.choice([None, None, f"o{rng.randrange(7)}"])) for i in range(120)]
    got = listings.matched_authors(spark.createDataFrame(stored, "author_id string, name string, openalex_id string"), spark.createDataFrame(rows, "ord long, name string, openalex_id string"))
    assert {r.ord: r.author_id for r in got.collect()} == sequence(stored, rows)


def test_keyword_chain_and_guard(spark):
    rows = spark.createDataFrame([(1, " graph nets ", ""), (2, "", " "), (3, None, "@a{k}")], "id int, prompt string, bibtex string")
    assert rows_of(keywords.guarded(rows), "id", "error") == [(1, None), (2, keywords.NO_INPUT), (3, None)]
    first = lambda r: r.where("id = 3").select("id", F.array(F.lit("told")).alias("keywords"))
    got = {r.id: (r.keywords, r.method, r.error) for r in keywords.generated(keywords.guarded(rows), {"model": first, "heuristic": keywords.heuristic}).collect()}
    assert got == {1: (["graph nets"], "heuristic", None), 2: ([], None, keywords.NO_RESULT), 3: (["told"], "model", None)}


def test_neighbours_and_seeds(spark):
    rows = spark.createDataFrame([(1, "r", 200, '{"data":[{"a":1},{"a":2},{"a":3}]}'), (2, "r", 200, '{"data":null}'), (3, "c", 500, '{"data":[{}]}'), (4, "c", 404, None)], "id int, kind string, status int, body string")
    assert rows_of(listings.neighbours(rows, 2), "id", "place", "raw") == [(1, 0, '{"a":1}'), (1, 1, '{"a":2}')]
    assert rows_of(listings.seed_errors(spark.createDataFrame([(1, 200), (2, 404), (3, 429), (4, 503), (5, None)], "id int, status int"))) == [(2, "not found"), (3, "rate limited"), (4, "upstream error"), (5, "network error")]


def test_merge_keeps_labels_without_parity(spark):
    p = as_papers(spark.createDataFrame([(0, None), (1, "A")], "ord long, m string"), "x", title=F.lit("t"), predicted_main_archetype=F.col("m"))
    groups = spark.createDataFrame([(0, 0), (1, 0)], "ord long, group_id long")
    assert [resolve.merged(p, groups, parity=x).first().predicted_main_archetype for x in (True, False)] == [None, "A"]
    assert {f.name for f in PAPER} <= set(resolve.merged(p, groups).columns)


def test_late_and_repeated_arrivals(spark, tmp_path):
    (tmp_path / "in").mkdir()
    ddl = "doi string, title string, at timestamp, value double, event_type string"
    put = lambda n, *rows: (tmp_path / "in" / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(("doi", "title", "at", "value", "event_type"), r, strict=True))) for r in rows))
    put(1, ("10.1/A", "x", "2024-01-01T00:00:00", 1.0, "e"), ("10.1/a", "y", "2024-01-01T00:05:00", 2.0, "e"), ("", " T ", "2024-01-01T00:06:00", 4.0, "f"))

    def run(name, make, mode):
        stream = make(spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")))
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"ck-{name}")).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
        return q

    first = run("first", lambda s: ingest.arrivals(s, "at"), "append")
    assert len(ingest.progress(first)) >= 1 and sum(p["rows"] for p in ingest.progress(first)) == 3
    assert sorted(r.arrival_key for r in spark.read.parquet(str(tmp_path / "first")).collect()) == ["10.1/a", "t"]
    put(2, ("10.1/a", "z", "2024-01-01T00:10:00", 8.0, "e"), ("10.1/b", "w", "2024-01-03T00:00:00", 16.0, "e"))
    run("first", lambda s: ingest.arrivals(s, "at"), "append")
    assert sorted(r.arrival_key for r in spark.read.parquet(str(tmp_path / "first")).collect()) == ["10.1/a", "10.1/b", "t"]
    run("days", lambda s: ingest.tumbling(s, "at"), "append")
    put(3, ("10.1/c", "late", "2024-01-01T01:00:00", 32.0, "e"), ("10.1/d", "v", "2024-01-09T00:00:00", 64.0, "e"))
    run("days", lambda s: ingest.tumbling(s, "at"), "append")
    got = {(str(r.window_start)[:10], r.event_type): (r.n, r.total) for r in spark.read.parquet(str(tmp_path / "days")).collect()}
    assert got[("2024-01-01", "e")] == (3, 11.0) and got[("2024-01-01", "f")] == (1, 4.0)  # the late event of value 32 is not counted
