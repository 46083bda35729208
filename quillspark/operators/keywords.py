"""Keyword generation: request guard, the frequency heuristic with keywords of a bibliography, a chain of generators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from quillspark.functions.text import candidate_phrases
from quillspark.operators.filters import keyword_ranking

# Longest bibliography that is read, and what is said of a request without input or result.
MOST_BIBTEX = 100_000
NO_INPUT = "Provide a research description or a .bib file."
NO_RESULT = "Could not derive keywords from the input."


def once(words: Column) -> Column:
    """Members of an array in order, the first of each spelling in any case."""
    low = F.transform(words, lambda x: F.lower(x))
    return F.filter(words, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def guarded(requests: DataFrame, prompt: str = "prompt", bibtex: str = "bibtex") -> DataFrame:
    """Requests with a trimmed prompt, a bibliography of at most ``MOST_BIBTEX`` characters ('' if blank), and error where both are blank."""
    bib = F.left(F.coalesce(F.col(bibtex), F.lit("")), F.lit(MOST_BIBTEX))
    rows = requests.withColumns({prompt: F.trim(F.coalesce(F.col(prompt), F.lit(""))), bibtex: F.when(F.trim(bib) != "", bib).otherwise("")})
    return rows.withColumn("error", F.when((F.col(prompt) == "") & (F.col(bibtex) == ""), NO_INPUT))


def context_keywords(context: Column) -> Column:
    """What follows ``Keywords:`` to the next | in each line of a bibliography's context, cut at commas and semicolons."""
    lines = F.filter(F.split(context, "\n"), lambda x: F.contains(x, F.lit("Keywords:")))
    held = F.transform(lines, lambda x: F.substring_index(F.regexp_replace(x, "^.*?Keywords:", ""), "|", 1))
    words = F.flatten(F.transform(held, lambda x: F.transform(F.split(x, "[;,]"), lambda w: F.trim(w))))
    return F.filter(words, lambda w: w != "")


def heuristic(requests: DataFrame, id_col: str = "id", prompt: str = "prompt", context: str | None = None, ranked: int = 10, most: int = 12) -> DataFrame:
    """(id, keywords): the ``ranked`` best phrases of the prompt, then those of the context, each once, ``most`` at most."""
    phrases = requests.select(id_col, candidate_phrases(prompt).alias("phrases"))
    best = keyword_ranking(phrases, id_col, "phrases", ranked)
    rows = requests.select(F.col(id_col).alias("id"), (F.col(context) if context else F.lit("")).alias("context")).join(best, "id", "left")
    words = F.concat(F.coalesce("keywords", F.array().cast("array<string>")), F.coalesce(context_keywords(F.col("context")), F.array().cast("array<string>")))
    return rows.select("id", F.slice(once(words), 1, most).alias("keywords"))


Generator = Callable[[DataFrame], DataFrame]


def generated(requests: DataFrame, chain: dict[str, Generator], id_col: str = "id", most: int = 12) -> DataFrame:
    """(id, keywords, method, error): the answer of the first generator of ``chain`` that gives a request any keyword.

    A generator takes requests and returns (id, keywords); requests that it leaves out or gives none go on to the
    next. What none answers has no keywords and an error.
    """
    out = requests.select(F.col(id_col).alias("id"), F.array().cast("array<string>").alias("keywords"), F.lit(None).cast("string").alias("method"))
    for name, generator in chain.items():
        rest = requests.join(out.where(F.size("keywords") > 0).select(F.col("id").alias(id_col)), id_col, "left_anti")
        told = generator(rest).where(F.size("keywords") > 0).select("id", F.slice("keywords", 1, most).alias("k"))
        out = out.join(told, "id", "left").select("id", F.coalesce("k", "keywords").alias("keywords"), F.when(F.col("k").isNotNull(), name).otherwise(F.col("method")).alias("method"))
    return out.withColumn("error", F.when(F.size("keywords") == 0, NO_RESULT))
