"""Sharding by a two-pass external shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from quillspark.llm.common import own_names


def sized(text_col: str):
    return (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + 1).cast("long")


def shuffled_shards(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text", seed: int = 11, bucket_bytes: int = 8 << 20) -> DataFrame:
    """``docs`` with the columns shard and slot: a random order of all rows, cut into shards whose row counts are at most one apart.

    Pass 1 scatters rows into buckets by a seeded hash of id and text; there are as many buckets as make
    them about ``bucket_bytes`` large, however large the table. Pass 2 puts each bucket into a fixed order, applies a Fisher-Yates shuffle with a generator seeded by
    (seed, bucket), and hands its rows on. A row's place in the order of all rows is its bucket's offset
    plus its place in the bucket; shard s holds places [s n / S, (s + 1) n / S), and slots count from 0.

    Only counts of buckets are summed up front, in groups of 4096 and inside each group; each bucket meets its
    offset where its rows meet. The result depends on rows and parameters only, not on partitions.
    Null and empty texts and null ids are rows like any other; rows equal in id and text share a bucket (and take any
    order among themselves). An empty table gives no rows. Columns of ``docs`` named shard or slot are
    replaced; all others keep their names and values.
    """
    docs = docs.drop("shard", "slot")
    total, n_rows = docs.agg(F.sum(sized(text_col)), F.count("*")).first()
    n_buckets = max(1, -(-int(total or 0) // bucket_bytes))
    h, b = own_names(docs, "h", "bucket")
    held = docs.withColumn(h, F.xxhash64(F.lit(seed), F.col(id_col), F.crc32(F.col(text_col))))
    held = held.withColumn(b, F.pmod(F.col(h), F.lit(n_buckets)).cast("long"))
    counts = held.groupBy(F.col(b).alias("bucket")).agg(F.count("*").alias("n")).withColumn("part", F.shiftright("bucket", 12))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = counts.groupBy("part").agg(F.sum("n").alias("n")).select("part", before(W.orderBy("part")).alias("earlier"))
    inside = counts.select("bucket", "part", before(W.partitionBy("part").orderBy("bucket")).alias("inside"))
    offsets = inside.join(parts, "part").select("bucket", (F.col("earlier") + F.col("inside")).alias("offset"))
    out = StructType([*docs.schema.fields, StructField("shard", IntegerType()), StructField("slot", LongType())])
    names, ids = docs.columns, docs.columns.index(id_col)

    def shuffle(table, told):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        bucket, offset = told["bucket"][0].as_py(), told["offset"][0].as_py()
        rows = table.select(names)
        ties = pa.table({"h": table[h], "id": rows.column(ids)})
        rows = rows.take(pc.sort_indices(ties, sort_keys=[("h", "ascending"), ("id", "ascending")]))
        order = np.arange(rows.num_rows)
        np.random.Generator(np.random.Philox(key=[seed, bucket])).shuffle(order)  # Fisher-Yates
        place = offset + np.arange(rows.num_rows, dtype=np.int64)
        shard = (n_shards * (place + 1) - 1) // n_rows
        slot = place - shard * n_rows // n_shards
        return rows.take(order).append_column("shard", pa.array(shard.astype(np.int32))).append_column("slot", pa.array(slot))

    return held.groupBy(b).cogroup(offsets.groupBy("bucket")).applyInArrow(shuffle, out)


def write_shards(docs: DataFrame, path: str, n_shards: int = 16, **how) -> None:
    """Writes ``shuffled_shards`` as Parquet, one folder ``shard=i`` each; slot orders the rows of a shard. An empty table gives an empty folder; other cases are as there."""
    shuffled_shards(docs, n_shards, **how).write.partitionBy("shard").parquet(path)
