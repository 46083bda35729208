"""Column functions: identifiers, queries, phrases, addresses, BibTeX."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import fuzzy, scores, text as T
from quillspark.operators.resolve import indel_ratio


def one(spark, expr, ddl=None, row=None):
    df = spark.createDataFrame([row], ddl) if ddl else spark.range(1)
    return df.select(expr.alias("x")).first().x


def test_strip_and_detect_operators(spark):
    cases = [('"large language model" AND LLM', '"large language model" LLM', True), ("(a OR b) AND c", "a b c", True), ("LLM NOT RAG", "LLM RAG", True), ("plain words", "plain words", False), ("and or", "and or", False), ("", "", False)]
    rows = spark.createDataFrame(cases, "raw string, want string, ops boolean").select("want", "ops", T.strip_boolean("raw").alias("got"), T.has_boolean_operators("raw").alias("has")).collect()
    assert all(r.got == r.want and r.has == r.ops for r in rows)


@pytest.mark.parametrize(("source", "n", "want"), [
    ("arxiv", 2, "(a) AND (b c)".replace("(a) AND (b c)", 'a AND "b c"')), ("dblp", 4, "a \"b c\" d e"), ("pubmed", 5, '(a AND "b c") AND (d OR e OR f)'), ("arxiv", 0, ""),
])
def test_build_query(spark, source, n, want):
    kws = F.slice(F.lit(["a", "b c", "d", "e", "f"]), 1, n) if n else F.array().cast("array<string>")
    assert one(spark, T.build_query(kws, F.lit(source))) == want


def test_parsed_keywords(spark):
    assert one(spark, T.parsed_keywords(F.lit('"deep nets" AND (Graph OR graph) x -bad'))) == ["deep nets", "Graph"]
    assert one(spark, T.parsed_keywords(F.lit('-"retrieval augmented" x "y" and "A b" or AND/OR not LLM a B'))) == ["y", "A b", "AND/OR", "LLM"]
    assert one(spark, T.parsed_keywords(F.lit(""))) == []


def test_keywords_to_query(spark):
    assert one(spark, T.keywords_to_query(F.lit(["a b", " ", "(c OR d)", "e"]))) == '"a b" AND (c OR d) AND e'


def test_matching(spark):
    df = spark.createDataFrame([(1, "Deep Nets", None), (2, "x deep", "nets y"), (3, None, None)], "id int, title string, abstract string")
    ids = lambda c: sorted(r.id for r in df.where(c).collect())
    assert ids(T.matches_all(["deep", "NETS"])) == [1, 2]
    assert ids(T.matches_any(["deep nets"])) == [1, 2]  # across the boundary of title and abstract
    assert ids(T.matches_any([" "])) == [] and ids(T.matches_any([])) == [1, 2, 3]


def test_normal_forms(spark):
    assert one(spark, T.norm_doi(F.lit("https://dx.doi.org/10.1/AB "))) == "10.1/ab"
    assert one(spark, T.norm_arxiv(F.lit("1234.5678v12"))) == "1234.5678"
    assert one(spark, T.norm_title(F.lit("  A-b: C! "))) == "ab c"
    assert one(spark, T.safe_int(F.lit("12.5"))) is None and one(spark, T.safe_int(F.lit(" 12 "))) == 12


def test_candidate_phrases(spark):
    assert one(spark, T.candidate_phrases(F.lit("Graph neural networks for the study of x-ray images, I say"))) == ["graph neural networks", "x-ray images", "say"]


def test_repo_and_dataset(spark):
    u = T.repo_url(F.lit(None).cast("string"), F.lit("code at https://github.com/a/b.git. and https://gitlab.com/c/d"))
    assert one(spark, u) == "https://github.com/a/b.git"  # one ending, then the dots
    assert one(spark, T.repo_url(F.lit("https://github.com/a/b.tar.gz"), F.lit(None).cast("string"))) == "https://github.com/a/b"
    assert one(spark, T.repo_url(F.lit("none"), F.lit("see https://github.com/a/b..."))) == "https://github.com/a/b"
    assert one(spark, T.repo_url(F.lit("https://gitlab.com/g/s/r"), F.lit("x"))) == "https://gitlab.com/g/s/r"
    assert one(spark, T.has_dataset(F.lit("The dataset is available"))) and not one(spark, T.has_dataset(F.lit(None).cast("string")))


def test_weighted_ratio():
    assert indel_ratio("abc", "abc") == 100 and indel_ratio("", "") == 100 and indel_ratio("ab", "cd") == 0
    assert indel_ratio("kitten", "sitting") == pytest.approx(100 * 2 * 4 / 13)
    assert fuzzy.weighted_ratio("new york mets", "mets york new") == 95
    assert fuzzy.weighted_ratio("yankees", "new york yankees") == 90
    assert fuzzy.weighted_ratio("", "a") == 0


def test_scores(spark):
    ddl = "citation_count long, has_public_code boolean, is_peer_reviewed boolean, has_dataset boolean, repo_stars long"
    assert one(spark, scores.composite_score(), ddl, (99, True, None, False, 9)) == 4.0
    assert one(spark, scores.composite_score(), ddl, (None, None, None, None, None)) == 0.0
    assert one(spark, scores.score_breakdown(scores.Weights(citations=2)), ddl, (99, True, None, False, 9)).score == 6.0
    assert one(spark, scores.middle_years(F.lit(2010), F.lit(2014))) == [2012] and one(spark, scores.middle_years(F.lit(2010), F.lit(2019))) == [2014, 2015]


def test_blend_and_labels(spark):
    assert one(spark, T.blend(F.lit("#000000"), F.lit("#ffffff"), 0.5)) == "#808080"
    assert one(spark, T.sources_label(F.lit(["semantic_scholar", "core"]), F.lit(["core"]))) == "semantic scholar"
    assert one(spark, T.describe_error(F.lit(503), F.lit("http"), F.lit(None).cast("string"))) == "Server error (HTTP 503)"
    assert one(spark, T.compact(F.lit(1234))) == "1.2k"


@pytest.mark.parametrize(("seconds", "want"), [
    (30, "just now"), (44, "just now"), (45, "1m ago"), (100, "2m ago"), (59 * 60, "59m ago"), (105 * 60, "2h ago"), (36 * 3600, "2d ago"), (29 * 86400, "29d ago"), (45 * 86400, "2mo ago"), (360 * 86400, "1y ago"), (-5, "just now"),
])
def test_relative_time(spark, seconds, want):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    assert one(spark, T.relative_time(now - F.make_dt_interval(secs=F.lit(seconds)), now)) == want


def test_lines_and_keys(spark):
    names = lambda n: F.lit([f"n{i}" for i in range(n)]) if n else F.array().cast("array<string>")
    assert [one(spark, T.author_line(names(n), 3, ", et al.", "—")) for n in (0, 2, 4)] == ["—", "n0, n1", "n0, n1, n2, et al."]
    assert one(spark, T.author_line(names(6), 5)) == "n0, n1, n2, n3, n4 et al." and one(spark, T.author_line(names(0))) == ""
    assert one(spark, T.failed_label(F.lit(["semantic_scholar", "core"]), F.create_map(F.lit("core"), F.lit("HTTP 500")))) == "semantic scholar, core (HTTP 500)"
    assert one(spark, T.paper_key(), "doi string, arxiv_id string, semantic_scholar_id string, openalex_id string, title string", ("", None, "s", "o", "t")) == "s"
    assert one(spark, T.source_query(F.lit("a AND (b)"), F.lit("dblp"))) == "a b" and one(spark, T.source_query(F.lit("a AND b"), F.lit("arxiv"))) == "a AND b"
    assert one(spark, T.cluster_color(F.lit(-1), ["r", "g", "b"])) == "b"
    entries = F.array(F.struct(F.lit("T").alias("title"), F.lit(["k", "l"]).alias("keywords"), F.lit("x" * 400).alias("abstract")), F.struct(F.lit(None).cast("string").alias("title"), F.array().cast("array<string>").alias("keywords"), F.lit("a").alias("abstract")))
    assert one(spark, T.bib_context(entries)) == "Title: T | Keywords: k, l | Abstract: " + "x" * 300
