"""Entity resolution against a plain sequential replay."""

import random
import re

from pyspark.sql import functions as F

from quillspark.operators import resolve
from quillspark.operators.components import connected_components
from quillspark.schemas import PAPER
from quillspark.sources.normalize import as_papers


def paper(spark, rows):
    df = spark.createDataFrame(rows, "ord long, doi string, arxiv_id string, title string, year int, citation_count long, src string, has_public_code boolean")
    return as_papers(df, "x", **{c: F.col(c) for c in ("doi", "arxiv_id", "title", "year", "citation_count", "has_public_code")}, sources=F.array("src"))


def test_components_of_chains_and_hubs(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(50)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(500, 500)]
    parent = {}
    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_components_of_long_chains_in_any_order(spark):
    ids = list(range(1000))
    random.Random(5).shuffle(ids)
    order = [2000, *range(2299, 2000, -1)]
    edges = [*zip(ids, ids[1:]), *zip(order, order[1:])]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: 0 if x < 1000 else 2000 for x in [*ids, *order]}


def replay(rows):
    ids, titles, out = {}, {}, {}
    clean = lambda t: "".join(c for c in t.lower() if c in "abcdefghijklmnopqrstuvwxyz0123456789 ").strip()
    for o, doi, arxiv, title, year, *_ in rows:
        keys = [("d", doi.lower()) if doi else None, ("a", arxiv) if arxiv else None]
        t = clean(title)
        g = next((ids[k] for k in keys if k in ids), None)
        if g is None and t:
            g = titles.get((t, year))
            if g is None:
                tokens = " ".join(sorted(t.split()))
                g = next((h for (s, y), h in titles.items() if y == year and resolve.indel_ratio(tokens, " ".join(sorted(s.split()))) >= 92), None)
        g = o if g is None else g
        for k in keys:
            if k:
                ids[k] = g
        if t:
            titles[t, year] = g
        out[o] = g
    return out


def test_greedy_groups_equal_the_sequential_rule(spark):
    rng = random.Random(5)
    base = ["deep graph networks for molecules", "a survey of language models in medicine", "fast joins on modern hardware", "stream processing with watermarks", ""]
    rows = []
    for o in range(120):
        t = rng.choice(base)
        if t and rng.random() < 0.6:
            i = rng.randrange(len(t))
            t = t[:i] + rng.choice("abc ") + t[i + rng.randrange(2) :]
        rows.append((o, rng.choice([None, None, f"10.1/{rng.randrange(20)}"]), rng.choice([None, None, f"20{rng.randrange(15)}"]), t, rng.choice([2000, 2001, None]), 1, "core", None))
    got = {r.ord: r.group_id for r in resolve.greedy_groups(paper(spark, rows)).collect()}
    assert got == replay(rows)


def test_fuzzy_links_lose_no_pair(spark):
    rng = random.Random(9)
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    titles = []
    for _ in range(60):
        t = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 7)))
        i = rng.randrange(len(t))
        titles += [t, t[:i] + rng.choice("xyz") + t[i + rng.randrange(2) :]]
    rows = [(i, None, None, t, 2000, 1, "core", None) for i, t in enumerate(titles)]
    got = {(r.src, r.dst) for r in resolve.fuzzy_links(paper(spark, rows)).collect()}
    key = lambda t: " ".join(sorted(t.split()))
    first = {}
    for i, t in enumerate(titles):
        first.setdefault(key(t), i)
    want = {(min(i, j), max(i, j)) for a, i in first.items() for b, j in first.items() if a < b and resolve.indel_ratio(a, b) >= 92}
    assert got == want


def test_merge_priority_and_truth(spark):
    p = paper(spark, [(0, "10.1/a", None, "", 2000, 0, "arxiv", False), (1, "10.1/A", None, "From crossref", 2001, 5, "crossref", None), (2, None, None, "alone", None, 0, "core", None)])
    groups = resolve.closure_groups(p)
    rows = {r.ord: r for r in resolve.merged(p, groups).collect()}
    assert (rows[0].title, rows[0].citation_count, rows[0].year, rows[0].has_public_code, rows[0].sources) == ("From crossref", 5, 2000, False, ["arxiv", "crossref"])
    assert (rows[2].title, rows[2].citation_count) == ("alone", 0)
    assert resolve.removed(p, groups).first().n_removed == 1
    assert resolve.first_kept(p).count() == 2


def test_texts_are_merged_by_number(spark):
    """The abstract of a group is its first by priority, a single record keeps what it has, and no text passes the grouping."""
    rows = [(0, "10.1/a", None, "", 2000, 1, "core", None), (1, "10.1/a", None, "", 2000, 1, "openalex", None), (2, "10.1/a", None, "", 2000, 1, "arxiv", None)]
    rows += [(k, f"10.1/{k // 2}", None, "", 2000, 1, "core", None) for k in (4, 5)] + [(k, None, None, "", 2000, 1, "core", None) for k in (6, 7, 8)]
    texts = {0: "of core", 1: "", 2: "of arxiv", 5: "", 6: "alone", 7: ""}
    p = paper(spark, rows).withColumn("abstract", F.create_map(*[F.lit(x) for kv in texts.items() for x in kv])[F.col("ord").cast("int")])
    m = resolve.merged(p, resolve.closure_groups(p))
    assert {r.ord: r.abstract for r in m.collect()} == {0: "of arxiv", 4: None, 6: "alone", 7: "", 8: None}
    assert m.columns == ["ord", "n_records", *[f.name for f in PAPER if f.name != "ord"]]
    assert not re.search(r"(min_by|first)\(abstract", m._jdf.queryExecution().optimizedPlan().toString())


def test_titles_are_cut_before_labels_are_joined(spark):
    """A query for titles alone joins no texts with labels."""
    from quillspark.plans import surrogate

    plan = surrogate.papers(spark, "/root/testdata/sf0.001").select("ord", "title", "is_peer_reviewed")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("substring_index")


def test_upsert_fills_nulls_within_projects(spark):
    old = paper(spark, [(0, "10.1/a", None, "t", None, 0, "arxiv", None)]).withColumn("project_id", F.lit(1))
    new = paper(spark, [(0, "10.1/a", "x1", "u", 1999, 3, "core", True), (1, None, "x1", "v", 1990, 9, "core", True), (2, None, None, "w", 1, 1, "core", None)]).withColumn("project_id", F.lit(1))
    rows = resolve.upserted(old, new.union(new.withColumn("project_id", F.lit(2)).where("ord = 0"))).collect()
    mine = {r.title: r for r in rows if r.project_id == 1}
    assert mine["t"].year == 1999 and mine["t"].citation_count == 0 and mine["t"].sources == ["arxiv", "core"]
    assert len([r for r in rows if r.project_id == 2]) == 1 and "w" in mine
    assert {f.name for f in PAPER} < set(rows[0].asDict())


def test_first_kept_and_upsert_follow_the_sequence(spark):
    rows = [(0, "10.1/a", None, "", 2000, 1, "core", None), (1, None, "x1", "", 2000, 1, "arxiv", None), (2, "10.1/a", "x1", "", 2000, 1, "dblp", None), (3, None, "x1", "", 2000, 1, "pubmed", None)]
    p = paper(spark, rows)
    assert {r.ord: r.sources for r in resolve.first_kept(p).collect()} == {0: ["core", "dblp", "pubmed"], 1: ["arxiv"]}
    assert {r.group_id for r in resolve.closure_groups(p).collect()} == {0}
    old = paper(spark, [(0, None, "x1", "s", None, 0, "arxiv", None)]).withColumn("project_id", F.lit(1))
    new = paper(spark, [(1, "10.1/d", "x1", "a", None, 0, "core", None), (2, "10.1/d", None, "b", 1999, 0, "dblp", None), (3, None, "x9", "c", 1, 0, "dblp", None)]).withColumn("project_id", F.lit(1))
    out = sorted((r.title, r.doi, r.arxiv_id, r.year, r.sources) for r in resolve.upserted(old, new).collect())
    assert out == [("c", None, "x9", 1, ["dblp"]), ("s", "10.1/d", "x1", 1999, ["arxiv", "core", "dblp"])]


def upserts(rows):
    """Names of the papers that records end in, one project, in sequence."""
    papers, out = [], {}
    for at, *ids in rows:
        found = next((p for k, x in enumerate(ids) if x for p in papers if p["ids"][k] == x), None)
        if found is None:
            papers.append(found := {"at": at, "ids": [None] * 3})
        found["ids"] = [a or b for a, b in zip(found["ids"], ids, strict=True)]
        out[at] = found["at"]
    return out


def test_upsert_groups_equal_a_sequence(spark):
    rng = random.Random(8)
    rows = [(at, *[rng.choice([None, None, f"{k}{rng.randrange(12)}"]) for k in "das"]) for at in range(70)]
    df = spark.createDataFrame([(1, *r) for r in rows] + [(2, *r) for r in rows[::2]], "project_id int, at long, doi string, arxiv_id string, semantic_scholar_id string")
    got = {(r.project_id, r.at): r.group_at for r in resolve.upsert_groups(df).collect()}
    assert got == {(1, k): v for k, v in upserts(rows).items()} | {(2, k): v for k, v in upserts(rows[::2]).items()}


def test_upsert_groups_need_no_call_a_part(spark):
    """Parts stream through few tasks, across batches that cut them, and no part is a call of its own."""
    rows = [(10 * k + i, f"d{k}" if i else None, f"x{k}" if i < 2 else None, None) for k in range(40) for i in range(3)]
    df = spark.createDataFrame([(1, *r) for r in rows], "project_id int, at long, doi string, arxiv_id string, semantic_scholar_id string")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        groups = resolve.upsert_groups(df)
        assert {r.at: r.group_at for r in groups.collect()} == upserts(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert "FlatMapGroups" not in groups._jdf.queryExecution().executedPlan().toString()


def test_tiles_lose_no_similar_title(spark):
    """Titles of few syllables, whose grams are all common: tiles find every pair by letter counts, and few others."""
    draw = random.Random(5)
    made = ["".join(draw.choice(["th", "re", "an", "ing ", "on", "der "]) for _ in range(draw.randint(4, 24))) for _ in range(120)]
    for t in made[:60]:
        at = draw.randrange(len(t))
        made.append(t[:at] + draw.choice("abc ") + t[at + draw.randint(0, 2) :])
    made = sorted(set(made))
    titled = spark.createDataFrame([(i % 2, i, t, len(t), len(made)) for i, t in enumerate(made * 2)], "year int, ord long, t string, n long, titles long")
    got = [(r.a, r.b) for r in resolve.tiled_pairs(titled, 0.08, tile=50).collect()]
    assert len(got) == len(set(got))
    both = made * 2
    similar = {(a, b) for b in range(len(both)) for a in range(b) if a % 2 == b % 2 and resolve.indel_ratio(both[a], both[b]) >= 92}
    assert len(similar) > 100 and similar <= set(got) and len(got) < len(both) ** 2 / 20


def test_an_abstract_is_inverted_without_a_shuffle(spark):
    from quillspark.plans import catalog

    plan = catalog.inverted_abstract(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
