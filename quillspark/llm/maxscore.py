"""Exact top-k by inner product: MaxScore over the components of vectors as query terms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

HITS = "query_id long, vec_id long, score long"


class Shard:
    """Postings of a shard's vectors, in blocks of documents.

    Component d gives two terms: (d, +) with impact x_d - low_d for queries with a positive weight, and
    (d, -) with impact high_d - x_d for negative ones; low and high are the shard's. Impacts are not
    negative, a document without one lacks the posting, and a score is the sum of weight times impact plus
    a constant of the query. A term's bound is its weight times (high_d - low_d).
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, block: int = 2048) -> None:
        self.low, self.high = vectors.min(axis=0), vectors.max(axis=0)
        self.blocks = []
        for a in range(0, len(ids), block):
            x = np.ascontiguousarray(vectors[a : a + block].T)
            self.blocks.append((ids[a : a + block], x - self.low[:, None], self.high[:, None] - x))

    def top(self, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the shard's k best, ties to smaller ids; rows of the query's own id take no part."""
        constant = int((q * np.where(q > 0, self.low, self.high)).sum())
        bound = np.abs(q) * (self.high - self.low)
        terms = np.flatnonzero(bound)
        terms = terms[np.argsort(bound[terms], kind="stable")]
        weights, signs, upto = np.abs(q[terms]).tolist(), (q[terms] > 0).tolist(), np.concatenate(([0], np.cumsum(bound[terms])))
        terms = terms.tolist()
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for named, plus, minus in self.blocks:
            least = int(scores[-1]) if len(ids) == k else -1
            essential = int(np.searchsorted(upto, least, side="left")) - 1 if least >= 0 else 0  # terms before it cannot reach ``least`` together
            essential = max(0, essential)
            total = np.zeros(len(named), np.int64)
            for t in range(len(terms) - 1, essential - 1, -1):  # all postings of the essential terms
                total += weights[t] * (plus if signs[t] else minus)[terms[t]]
            near = np.flatnonzero((total + upto[essential] >= least) & (named != query_id))
            total = total[near]
            for t in range(essential - 1, -1, -1):  # the others are probed while a document competes
                if not len(near):
                    break
                total = total + weights[t] * (plus if signs[t] else minus)[terms[t]][near]
                left = total + upto[t] >= least
                if not left.all():
                    near, total = near[left], total[left]
            if len(near):
                ids, scores = np.concatenate((ids, named[near])), np.concatenate((scores, total))
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]
        return ids, scores + constant


def whole_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, v): v holds floor(scale * x) of each component. Rows whose id or vector is null, or that hold a null or non-finite component, are left out."""
    bad = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = table.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(~bad)
    v = F.transform(F.col(vector_col), lambda x: F.floor(scale * x.cast("double")).cast("long"))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))


def top_k(vectors: DataFrame, asked: Column, k: int = 5, shard_rows: int = 16_384, query_rows: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``vectors`` (vec_id, v) where ``asked`` holds, its ``k`` best among all other rows.

    Exact: integer inner products, ties to the smaller vec_id; all candidates where there are fewer than k.
    Rows are dealt by hash into shards of about ``shard_rows``, queries into blocks of about
    ``query_rows``; each (block, shard) cell is searched by itself, and a query's shard results are merged.
    So each task holds one shard and one block, whatever the table's size.

    Vectors of unequal length count as filled up with zeros; an empty vector scores 0 with all. Of rows
    that repeat a query's id the one with the smallest vector is the query, and none of them is its
    candidate; repeated candidates keep their own ranks. Components must stay below 2^28 in absolute value, so
    that sums are exact. An empty table gives no rows.
    """
    n, n_asked = vectors.agg(F.count("*"), F.count(F.when(asked, 1))).first()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-n_asked // query_rows))
    deal = lambda col, m, seed: F.pmod(F.xxhash64(F.lit(seed), col), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    queries = vectors.where(asked).groupBy("vec_id").agg(F.min("v").alias("v"))
    queries = queries.select(F.lit(True).alias("asks"), "vec_id", "v", deal("vec_id", blocks, 1).alias("block"), every(shards).alias("shard"))
    held = vectors.select(F.lit(False).alias("asks"), "vec_id", "v", every(blocks).alias("block"), F.pmod(F.xxhash64(F.lit(2), "vec_id", "v"), F.lit(shards)).cast("int").alias("shard"))

    def search(table):
        import pyarrow as pa

        asks = table["asks"].to_numpy()
        ids = table["vec_id"].to_numpy()
        flat = table["v"].combine_chunks()
        sizes = np.diff(flat.offsets.to_numpy())
        vectors = np.zeros((len(ids), max(1, int(sizes.max(initial=0)))), np.int64)
        vectors[np.arange(vectors.shape[1]) < sizes[:, None]] = flat.flatten().to_numpy(zero_copy_only=False)
        if np.abs(vectors).max(initial=0) >= 1 << 28:
            raise ValueError("a component of 2^28 or more")
        found = []
        if asks.any() and not asks.all():
            shard = Shard(ids[~asks], vectors[~asks])
            for query_id, q in zip(ids[asks].tolist(), vectors[asks], strict=True):
                hits, scores = shard.top(query_id, q, k)
                found.append((np.full(len(hits), query_id), hits, scores))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3
        return pa.table(columns, names=["query_id", "vec_id", "score"])

    hits = queries.unionByName(held).groupBy("block", "shard").applyInArrow(search, HITS)
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


OP8_SQL = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
