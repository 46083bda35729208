"""Predicates, facets and orders over scored papers."""

from __future__ import annotations

import heapq
from collections import Counter
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quillspark.functions.text import filled

# The eight primary labels.
ARCHETYPES = ["The Innovator", "The Evaluator", "The Combiner", "The Analyst", "The Synthesizer", "The Translator", "The Architect", "The Resource Creator"]


@dataclass(frozen=True)
class Filters:
    min_year: int | None = None
    max_year: int | None = None
    min_citations: int | None = None
    max_citations: int | None = None
    code_only: bool = False
    peer_reviewed_only: bool = False
    open_access_only: bool = False
    archetypes: list[str] | None = None
    sources: list[str] = field(default_factory=list)
    #: Drop secondary labels that are no primary label even with everything selected.
    strict_parity: bool = False


def predicate(f: Filters) -> Column:
    """A year bound drops null years; null citations count 0; code: flag or address; unlabelled papers pass the label facet."""
    out = F.lit(True)
    if f.min_year is not None:
        out = out & (F.col("year") >= f.min_year)
    if f.max_year is not None:
        out = out & (F.col("year") <= f.max_year)
    cited = F.coalesce(F.col("citation_count"), F.lit(0))
    if f.min_citations is not None:
        out = out & (cited >= f.min_citations)
    if f.max_citations is not None:
        out = out & (cited <= f.max_citations)
    if f.code_only:
        out = out & (F.coalesce(F.col("has_public_code"), F.lit(False)) | filled("code_url").isNotNull())
    if f.peer_reviewed_only:
        out = out & F.coalesce(F.col("is_peer_reviewed"), F.lit(False))
    if f.open_access_only:
        out = out & F.coalesce(F.col("is_open_access"), F.lit(False))
    selected = ARCHETYPES if f.archetypes is None and f.strict_parity else f.archetypes
    if selected is not None and (f.strict_parity or set(selected) != set(ARCHETYPES)):
        for c in ("predicted_main_archetype", "predicted_second_tier_archetype"):
            out = out & (F.col(c).isNull() | F.col(c).isin("None", *selected))
    if f.sources:
        out = out & F.arrays_overlap("sources", F.lit(f.sources))
    return out


def needs_classification() -> Column:
    return (F.trim(F.coalesce(F.col("abstract"), F.lit(""))) != "") & F.col("predicted_main_archetype").isNull()


def order(mode: str = "relevancy") -> list[Column]:
    """Columns to sort by; null counts 0, input order breaks ties."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    by = {
        "relevancy": zero("score").desc(), "year_desc": zero("year").desc(), "year_asc": zero("year").asc(),
        "citations_desc": zero("citation_count").desc(), "citations_asc": zero("citation_count").asc(), "title": F.lower("title").asc(),
    }[mode]
    return [by, F.col("ord").asc()]


def top(df: DataFrame, n: int, *by: Column) -> DataFrame:
    return df.orderBy(*by).limit(n)


def page(df: DataFrame, number: int, size: int = 10, *by: Column) -> DataFrame:
    """Page ``number`` from 1: a bounded top-k, not a sort of everything, for pages near the front."""
    return df.orderBy(*by).offset((number - 1) * size).limit(size)


def page_window(current: int, pages: int, reach: int = 2) -> list[int | None]:
    """Page numbers to show: first, last and those within ``reach`` of the current one; None for a gap."""
    shown = sorted({1, pages, *range(max(1, current - reach), min(pages, current + reach) + 1)})
    out: list[int | None] = []
    for n in shown:
        if out and out[-1] is not None and n > out[-1] + 1:
            out.append(None)
        out.append(n)
    return out


def bounds(df: DataFrame) -> DataFrame:
    """Range of years (2000 to 2026 if none) and most citations (100 if none or 0)."""
    return df.agg(
        F.coalesce(F.min("year"), F.lit(2000)).alias("min_year"), F.coalesce(F.max("year"), F.lit(2026)).alias("max_year"),
        F.coalesce(F.nullif(F.max("citation_count"), F.lit(0)), F.lit(100)).alias("max_citations"),
    )


def distribution(df: DataFrame, labels: list[str], main: str = "predicted_main_archetype") -> DataFrame:
    """(label, n, percent) over all labels, zeros included; percent of the labelled, halves up."""
    dim = df.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    counts = df.where(F.col(main).isin(labels)).groupBy(F.col(main).alias("label")).agg(F.count("*").alias("n"))
    n = F.coalesce(F.col("n"), F.lit(0))
    total = F.sum(n).over(W.partitionBy())
    return dim.join(counts, "label", "left").select("label", n.alias("n"), F.when(total > 0, F.floor(100 * n / total + 0.5)).otherwise(0).cast("long").alias("percent"))


def facet_counts(df: DataFrame, *cols: str) -> DataFrame:
    """(label, n): papers that carry the label in any of the columns, each counted once."""
    labels = F.array_distinct(F.array(*cols))
    return df.select(F.explode(labels).alias("label")).where("label is not null and label <> 'None'").groupBy("label").agg(F.count("*").alias("n"))


def source_counts(df: DataFrame, known: list[str]) -> DataFrame:
    """(source, n) over the known sources, zeros included."""
    dim = df.sparkSession.createDataFrame([(x,) for x in known], "source string")
    counts = df.select(F.explode(F.array_distinct("sources")).alias("source")).groupBy("source").agg(F.count("*").alias("n"))
    return dim.join(counts, "source", "left").select("source", F.coalesce("n", F.lit(0)).alias("n"))


def bar_widths(df: DataFrame, value: str) -> DataFrame:
    """``df`` with width: percent of the largest value, 2 at least."""
    most = df.agg(F.max(value).alias("__most"))  # one row
    return df.join(F.broadcast(most), F.lit(True)).withColumn("width", F.greatest(F.lit(2), F.round(100 * F.col(value) / F.col("__most"))).cast("long")).drop("__most")


def star_tiers(df: DataFrame, score: str = "score", gold: float = 0.01, silver: float = 0.05) -> DataFrame:
    """``df`` with tier: gold or silver by the score at place ceil(n * share) from the top, ties included, else null.

    Both thresholds come from counts by score: scores are rounded to hundredths, so they are few however many
    rows there are, and only that table is summed up in order.
    """
    counts = df.groupBy(F.col(score).alias("s")).agg(F.count("*").alias("k"))
    upto = F.sum("k").over(W.orderBy(F.desc_nulls_last("s")))
    n = F.sum("k").over(W.partitionBy())
    places = counts.withColumns({"upto": upto, "n": n})
    at = lambda share: F.max(F.when(F.col("upto") >= F.greatest(F.lit(1), F.ceil(F.col("n") * share)), F.col("s")))
    least = places.agg(at(gold).alias("__gold"), at(silver).alias("__silver"))
    s = F.col(score)
    tiered = df.join(F.broadcast(least), F.lit(True))  # one row
    return tiered.withColumn("tier", F.when(s >= F.col("__gold"), "gold").when(s >= F.col("__silver"), "silver")).drop("__gold", "__silver")


def _ranked(phrases, limit: int, most_words: int) -> list[str]:
    """One row's ranking: phrases in order of their first place."""
    f = Counter(w for p in phrases for w in p.split(" "))
    scored = []
    for pos, p in enumerate(dict.fromkeys(phrases)):
        words = p.split(" ")[:most_words]
        scored.append((-sum(f[w] for w in words) * len(words), pos, " ".join(words)))
    return [kw for _, _, kw in heapq.nsmallest(limit, scored)]


def keyword_ranking(df: DataFrame, id_col: str, phrases: str, limit: int = 10, most_words: int = 4) -> DataFrame:
    """(id, keywords): phrases ranked by (sum of word frequencies) * words, ties by place, cut to ``most_words`` words after duplicates are dropped. Rows without phrases go.

    A row's ranking needs nothing but the row, so nothing is shuffled; counting a row's words in linear time has no expression, hence one Arrow function.
    """

    @F.pandas_udf("array<string>")
    def ranked(column: pd.Series) -> pd.Series:
        return column.map(lambda p: _ranked(p, limit, most_words), na_action="ignore")

    # Said not to be deterministic, so that the condition stays above it and neither it nor the phrases are computed twice.
    return df.select(F.col(id_col).alias("id"), ranked.asNondeterministic()(phrases).alias("keywords")).where(F.size("keywords") > 0)
