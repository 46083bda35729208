"""Language-model scores of many short rows, of much repeated pairs, and of words that share a name."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from quillspark.llm import context_mixing


def scores(spark, rows):
    table = spark.createDataFrame(rows, "doc_id long, text string, held boolean")
    return {r.doc_id: r for r in context_mixing.scored(table, F.col("held")).collect()}


def test_many_short_rows(spark):
    got = context_mixing.scored(spark.range(120_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), "id").alias("text")), F.col("doc_id") % 5 == 1)
    told = got.agg(F.count("*").alias("n"), F.sum("n_tokens").alias("tokens"), F.max("train_tokens").alias("trained"), F.sum(F.col("n_known")).alias("known")).first()
    assert tuple(told) == (120_000, 240_000, 192_000, 96_000 * 2 + 24_000)


def test_a_pair_seen_more_than_65535_times(spark):
    often = "a b c " * 70_000
    got = scores(spark, [(1, often, False), (2, often, False), (3, "a b c a b c a b c", True), (4, "a b c a b z a b c", True)])
    assert got[3].score > -8 and got[3].score > got[4].score + 1  # the end alone, seen twice in 420,000 tokens, costs over 5


@pytest.mark.parametrize("known", [False, True])
def test_words_of_one_name_share_its_probability(spark, known):
    seen = {}
    for i in range(1_000_000):
        word = f"q{i}"
        key = xxh64_intdigest(word.encode(), 42) & 0xFFFFFFFF
        if key in seen:
            break
        seen[key] = word
    one, other = seen[key], word
    rows = [(i, f"a b {one}", False) for i in range(200)] + [(1000, f"a b {one}", True), (1001, f"a b {other}", True)] + [(2000 + i, other, False) for i in range(200 * known)]
    got = scores(spark, rows)
    both = 10 ** got[1000].score + 10 ** got[1001].score
    assert both <= 1 and got[1000].score > (-0.6 if known else -0.3)
    assert known or got[1001].score < -2
