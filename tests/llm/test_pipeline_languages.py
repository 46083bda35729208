"""The pipeline's first stage gives documents without a label the language found."""

from __future__ import annotations

from pyspark.sql import functions as F


def test_stage_fills_missing_languages(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where(F.length("text") > 400)
    true = {r.doc_id: r.lang for r in docs.collect()}
    hidden = docs.withColumn("lang", F.when(F.col("doc_id") % 4 != 1, F.col("lang")))
    got = {r.doc_id: r.lang for r in dict(cp.STAGES)["language_id"](spark, hidden, "").collect()}
    asked = [i for i in got if i % 4 == 1]
    assert asked and None not in got.values() and sum(got[i] == true[i] for i in asked) >= 0.9 * len(asked)
    assert all(got[i] == true[i] for i in got if i % 4 != 1)
