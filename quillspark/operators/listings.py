"""Joins and orders of a user's lists: scores from elsewhere, overriding copies, shelves, author and node records."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quillspark.session import stored


def with_scores(papers: DataFrame, told: DataFrame, local: Column) -> DataFrame:
    """Papers with score: that of ``told`` (title, score) under the title in lower case, else ``local``. Of several told for one title the last by ``ord`` counts, the largest without one."""
    last = F.max_by("score", "ord") if "ord" in told.columns else F.max("score")
    by_title = told.groupBy(F.lower("title").alias("low")).agg(last.alias("told"))
    rows = papers.withColumn("low", F.lower("title")).join(by_title, "low", "left")
    return rows.withColumn("score", F.coalesce("told", local)).drop("low", "told")


def overridden(selection: DataFrame, layers: list[DataFrame], key: Column) -> DataFrame:
    """Rows of ``layers`` (equal columns) that ``selection`` (id, place) names by ``key``, in its order; a later layer's row wins, then the later ``ord``. Unknown ids go."""
    ranked = [x.withColumns({"id": key, "layer": F.lit(k)}) for k, x in enumerate(layers)]
    every = ranked[0]
    for x in ranked[1:]:
        every = every.unionByName(x)
    rest = [c for c in every.columns if c not in ("id", "layer")]
    top = every.groupBy("id").agg(F.max_by(F.struct(*rest), F.struct("layer", "ord")).alias("r"))
    return selection.select("id", "place").join(top, "id").select("place", "id", "r.*").orderBy("place")


def listing(rows: DataFrame, by: str, newest_first: bool = True) -> DataFrame:
    """Rows by time, ties by ord."""
    return rows.orderBy(F.col(by).desc_nulls_last() if newest_first else F.col(by).asc_nulls_last(), "ord")


def recent(rows: DataFrame, by: str = "last_used_at", n: int = 5) -> DataFrame:
    """The ``n`` rows used last: a bounded top-k."""
    return listing(rows, by).limit(n)


def with_citation_counts(papers: DataFrame, counts: DataFrame) -> DataFrame:
    """Papers with citation_count from ``counts`` (arxiv_id, citation_count) where it tells one; others stay."""
    told = counts.where("citation_count is not null").groupBy("arxiv_id").agg(F.max("citation_count").alias("told"))
    joined = papers.join(told.where("arxiv_id <> ''"), "arxiv_id", "left")
    return joined.withColumn("citation_count", F.coalesce("told", "citation_count")).select(papers.columns)


def first_apart(pairs: DataFrame) -> DataFrame:
    """Of ``pairs`` (ord, name, oa) those that make an author in sequence: a pair does if no earlier one that does has its name or its oa (null: none).

    In rounds over all pairs at once: a pair that is the first undecided one of its name and of its oa makes an author, and decides all others of
    that name or oa against them. Rounds are as many as pairs in the longest run in which each waits for the one before; a common name is one partial aggregate and one join, not a task.
    """
    left, made = stored(pairs), []
    while not left.isEmpty():
        of = lambda c: left.where(F.col(c).isNotNull()).groupBy(c).agg(F.min("ord").alias(f"first_{c}"))
        marked = left.join(of("name"), "name", "left").join(of("oa"), "oa", "left")
        leads = (F.coalesce("first_name", "ord") == F.col("ord")) & (F.coalesce("first_oa", "ord") == F.col("ord"))
        made.append(stored(marked.where(leads).select("ord", "name", "oa")))
        left = stored(left.join(made[-1].select("name"), "name", "left_anti").join(made[-1].where("oa IS NOT NULL").select("oa"), "oa", "left_anti").join(made[-1].select("ord"), "ord", "left_anti").select("ord", "name", "oa"))
    return functools.reduce(DataFrame.unionByName, made) if made else left


def matched_authors(held: DataFrame, incoming: DataFrame) -> DataFrame:
    """(ord, author_id, created) of each author in ``incoming`` (ord, name, openalex_id): the stored author (author_id, name, openalex_id) of that
    OpenAlex id, else of exactly that name, else a new one, which later rows find in the same two ways.

    A new author's author_id is 'new:' and the ord of the row that made it; an author keeps the OpenAlex id it was made with. Only the first row of each
    (name, openalex_id) can make an author, and of those the ones that ``first_apart`` tells do.
    """
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    held = held.select(F.col("author_id").cast("string").alias("author_id"), "name", blank("openalex_id").alias("oa"))
    rows = incoming.select("ord", "name", blank("openalex_id").alias("oa"))
    by_oa = held.where("oa is not null").groupBy("oa").agg(F.min("author_id").alias("of_oa"))
    by_name = held.groupBy("name").agg(F.min("author_id").alias("of_name"))
    pairs = rows.groupBy("name", "oa").agg(F.min("ord").alias("ord")).join(by_oa, "oa", "left").join(by_name, "name", "left")
    # A pair that storage settles makes nothing.
    made = first_apart(pairs.where("of_oa is null and of_name is null").select("ord", "name", "oa"))
    new_id = F.concat(F.lit("new:"), F.col("ord"))
    new_name = made.select("name", new_id.alias("new_name"))
    new_oa = made.where("oa is not null").select("oa", F.col("ord").alias("since"), new_id.alias("new_oa"))
    met = rows.join(by_oa, "oa", "left").join(new_oa, "oa", "left").join(by_name, "name", "left").join(new_name, "name", "left")
    chosen = F.coalesce("of_oa", F.when(F.col("since") <= F.col("ord"), F.col("new_oa")), "of_name", "new_name")
    return met.select("ord", chosen.alias("author_id"), (chosen == F.concat(F.lit("new:"), F.col("ord"))).alias("created"))


NODE = (
    "paperId string, externalIds struct<DOI:string,ArXiv:string>, title string, abstract string, year int, citationCount bigint, referenceCount bigint, authors array<struct<name:string>>,"
    " journal string, isOpenAccess boolean, openAccessPdf struct<url:string>, fieldsOfStudy array<string>"
)


def graph_nodes(landed: DataFrame, raw: str = "raw", hop: str = "hop") -> DataFrame:
    """Nodes of a citation graph out of landed JSON (raw, hop): rows without an id go; journal is an object's name or a plain string; lists are never null."""
    r = landed.select(F.col(hop).alias("hop"), F.from_json(F.col(raw), NODE).alias("r")).where("coalesce(r.paperId, '') <> ''").select("hop", "r.*")
    journal = F.when(F.col("journal").startswith("{"), F.get_json_object("journal", "$.name")).otherwise(F.col("journal"))
    return r.select(
        F.col("paperId").alias("paper_id"), F.col("externalIds.DOI").alias("doi"), F.col("externalIds.ArXiv").alias("arxiv_id"), F.coalesce("title", F.lit("")).alias("title"), "abstract", "year",
        F.col("citationCount").alias("citation_count"), F.col("referenceCount").alias("reference_count"),
        F.transform(F.coalesce("authors", F.array().cast("array<struct<name:string>>")), lambda a: F.coalesce(a["name"], F.lit(""))).alias("authors"), journal.alias("journal"),
        F.coalesce("isOpenAccess", F.lit(False)).alias("is_open_access"), F.col("openAccessPdf.url").alias("pdf_url"), F.coalesce("fieldsOfStudy", F.array().cast("array<string>")).alias("fields_of_study"), "hop",
    )


def node_papers(nodes: DataFrame, score: Column) -> DataFrame:
    """Nodes as papers: the id stands in both id columns, flags are false, stars 0."""
    no = {c: F.lit(False) for c in ("has_public_code", "is_peer_reviewed", "has_dataset")}
    ids = {"openalex_id": F.col("paper_id"), "semantic_scholar_id": F.col("paper_id"), "repo_stars": F.lit(0).cast("long"), "score": score}
    return nodes.withColumns(ids | no).drop("paper_id", "hop", "fields_of_study")


def neighbours(answers: DataFrame, limit: int = 100) -> DataFrame:
    """(id, kind, place, raw): members of ``data`` in landed answers (id, kind, status, body), the first ``limit`` of each. Errors, absent papers and null data give none."""
    data = F.from_json("body", "data array<string>")["data"]
    rows = answers.where("status < 400").select("id", "kind", F.posexplode(F.slice(data, 1, limit)).alias("place", "raw"))
    return rows.where("raw is not null")


def seed_errors(answers: DataFrame) -> DataFrame:
    """(id, error) of seed answers (id, status): not found and upstream errors are told apart."""
    what = F.when(F.col("status") == 404, "not found").when(F.col("status") == 429, "rate limited").when(F.col("status").isNull(), "network error").when(F.col("status") >= 400, "upstream error")
    return answers.select("id", what.alias("error")).where("error is not null")


def scored_papers(papers: DataFrame, scores: DataFrame) -> DataFrame:
    """(place, id, score, authors, title) of ``scores`` (id, score) joined back to the papers they are of, best first, ties by id: a score of no known paper goes, of several scores of a paper the largest counts."""
    best = scores.where("id IS NOT NULL").groupBy("id").agg(F.max("score").alias("score"))
    rows = best.join(papers.select("id", "authors", "title"), "id")
    return numbered(rows, [F.desc_nulls_last("score"), F.asc("id")]).select("place", "id", "score", "authors", "title")


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with ``place``, their number from 1 in ``order``: sorted by ranges, each of which begins where those before it end, one count a range."""
    spread = stored(stored(rows).repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    before = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    begins = spread.groupBy("__range").agg(F.count("*").alias("__rows")).select("__range", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__earlier"))
    placed = spread.join(begins, "__range").withColumn("place", F.row_number().over(W.partitionBy("__range").orderBy(*order)) + F.col("__earlier"))
    return placed.drop("__range", "__earlier")


def with_children(parents: DataFrame, on: str, **children: tuple[DataFrame, list[Column]]) -> DataFrame:
    """``parents`` with one array column for each of ``children`` (name: (rows, order)): its rows of the same ``on`` as structs in that order; empty where a parent has none.

    A parent's children become one row: use it for what belongs to one parent, such as a paper's authors or identifiers.
    """
    out = parents
    for name, (rows, order) in children.items():
        rest = [c for c in rows.columns if c != on]
        keyed = rows.select(on, F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.struct(*rest).alias("row")).alias("one"))
        listed = keyed.groupBy(on).agg(F.transform(F.sort_array(F.collect_list("one")), lambda x: x["row"]).alias(name))
        out = out.join(listed, on, "left").withColumn(name, F.coalesce(name, F.array().cast(listed.schema[name].dataType)))
    return out
