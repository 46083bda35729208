"""Exact duplicates: rows grouped by a 128-bit hash of the folded text, compared byte for byte inside a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from quillspark.llm.common import fold, own_names


def grouped(rows: DataFrame, keep: str) -> DataFrame:
    """(h, text_sha256, keep_id, group_size), one row for each distinct text of ``rows`` (doc_id, folded)."""
    end = {"min": F.min, "max": F.max}[keep]
    groups = rows.groupBy(F.md5("folded").alias("h"), "folded").agg(end("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return groups.select("h", F.sha2("folded", 256).alias("text_sha256"), "keep_id", "group_size")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row for each row of ``docs``.

    Texts are equal when identical after lower-casing A-Z only; null counts as empty. Of equal texts the
    row with the smallest (``keep="min"``) or largest (``"max"``) id stays.

    The first aggregation has hash and folded text as its key: rows meet by hash, and only byte-equal
    texts share a group. It combines before the shuffle, so a huge group of copies moves as one row from
    each task. Rows find their group by MD5 and SHA-256 of the text, an equi-join whose hot keys adaptive
    execution splits over tasks; no text moves there.

    Null ids: a group of only null ids keeps all its rows (keep_id null, kept true); else null ids are
    dropped. Rows that repeat the kept id with an equal text are all marked kept. Other columns are
    ignored. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), fold(F.col(text_col)).alias("folded"))
    groups = grouped(rows, keep)
    members = rows.select("doc_id", F.md5("folded").alias("h"), F.sha2("folded", 256).alias("text_sha256"))
    return members.join(groups, ["h", "text_sha256"]).select(
        "doc_id", "keep_id", "group_size",
        (F.col("keep_id").isNull() | F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False))).alias("kept"), "text_sha256",
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The rows of ``docs`` that stay by ``exact_duplicates``, with all their columns, whatever their names. Rows that repeat a kept id and its text stay once, as do equal texts that all lack an id."""
    rows = docs.select(F.col(id_col).alias("doc_id"), fold(F.col(text_col)).alias("folded"))
    named = lambda of, sha: F.concat_ws(" ", sha, of.cast("string"))
    key, turn = own_names(docs, "key", "turn")
    stay = grouped(rows, keep).select(named(F.col("keep_id"), F.col("text_sha256")).alias(key))
    keyed = docs.withColumn(key, named(F.col(id_col), F.sha2(fold(F.col(text_col)), 256))).join(stay, key, "left_semi")
    # The window meets rows where the join has sorted them; no row moves again.
    return keyed.withColumn(turn, F.row_number().over(W.partitionBy(key).orderBy(key))).where(F.col(turn) == 1).select(docs.columns)


OP4_SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS f FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY f) AS keep_id, count(*) OVER (PARTITION BY f) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY f) AS kept, sha256(f) AS text_sha256
FROM t
"""
