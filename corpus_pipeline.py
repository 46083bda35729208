"""The training-data pipeline: documents in, packed sequences out. Each stage calls one operator of ``quillspark.llm``."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.llm import exact_dedup, langid, mixing, packing, similar
from quillspark.session import shared_dir, swept, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text shows a language go on, with the language found where they name none; null texts and texts without a letter (``und``) go."""
    docs = docs.select(COLUMNS)
    told = langid.identified(docs.withColumn("label", F.col("lang")), lang_col="label", carry=tuple(COLUMNS[1:]))
    return told.where(F.col("lang_pred") != langid.UNKNOWN).withColumn("lang", F.coalesce("lang", "lang_pred")).select(COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id goes on."""
    return exact_dedup.drop_exact_duplicates(docs.select(COLUMNS), keep="max")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by Jaccard similarity of 0.8 or more over 5-word shingles, the one with the smallest doc_id goes on."""
    return similar.drop_near_duplicates(docs.select(COLUMNS), shingle=5, least=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix(docs.select(COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens, with their ids."""
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_languages),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: SQL cannot express language ID, fingerprint links and packing; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again. When a stage is written, the one before it and its own side tables go."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    done: list[str] = []
    for name, stage in STAGES:
        mark = written()
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        swept(spark, mark, *done)
        done = [f"{folder}/{name}"]
    return docs
