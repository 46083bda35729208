"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.llm import chat, collocations, context_mixing, exact_dedup, huffman, langid, licenses, maxscore, mixing, packing, sharding, simhash, whitening
from quillspark.session import shared_dir


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    huffman.write_ids(documents(spark, sf_dir), folder, bpe())
    return huffman.read_ids(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shuffled_shards(documents(spark, sf_dir).select("doc_id", "text"), 16)
    return rows.select("doc_id", sharding.sized("text").alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
                       F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir), keep="max")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir), licenses.known(spark))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(documents(spark, sf_dir)).drop("draw")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir), bpe()).drop("ids")


def op8_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = maxscore.whole_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return maxscore.top_k(vectors, F.col("vec_id") % 50 == 0)


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.scored(documents(spark, sf_dir), F.crc32(F.col("doc_id").cast("string")) % 5 == 1)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(documents(spark, sf_dir), F.crc32(F.col("doc_id").cast("string")) % 4 == 2)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.formatted(turns.unionByName(spark.sql(chat.TRAP))))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_simhash, op2_token_ids, op3_sharding, op4_exact_dedup, op5_licenses, op6_mixing, op7_packing, op8_maxscore, op9_lm_score, op10_language_id,
                                 op11_whitening, op12_chat_format, op13_collocations, pipeline)}
ORACLES = {"op4_exact_dedup": exact_dedup.OP4_SQL, "op5_licenses": licenses.oracle_sql(), "op8_maxscore": maxscore.OP8_SQL,
           "op12_chat_format": chat.OP12_SQL, "op13_collocations": collocations.OP13_SQL}
