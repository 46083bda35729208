"""SimHash near-dedup with an exact check, for similarities whose fingerprints are too far apart for equal parts.

At a Jaccard similarity of 0.8 two 64-bit fingerprints differ in about 10 bits, so no choice of parts that must agree is
selective. Documents therefore meet in blocks of equal bands of least shingle hashes; inside a block fingerprints are
compared bit-sliced within a wide radius, and the shingle sets of what is left decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F

from quillspark.llm.common import own_names
from quillspark.llm.simhash import majority, within
from quillspark.operators.components import connected_components
from quillspark.session import cut, stored


def shingles(text: str | None, width: int = 5, seed: int = 42) -> np.ndarray:
    """Distinct XXH64 of the lower-cased (A-Z) text's word shingles, sorted; ``width`` words or fewer are one shingle."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    count = max(1, len(words) - width + 1)
    spans = zip(starts[:count].tolist(), ends[width - 1 :].tolist(), strict=True) if len(words) > width else [(0, len(joined))]
    return np.unique(np.array([xxh64_intdigest(joined[a:b], seed) for a, b in spans], np.uint64))


def band_keys(found: np.ndarray, factors: np.ndarray, terms: np.ndarray, rows: int) -> np.ndarray:
    """One key a band of ``rows`` MinHash values."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 2048):
        least = np.minimum(least, (found[at : at + 2048, None] * factors + terms).min(axis=0))
    return ((least >> np.uint64(17)) * factors).reshape(-1, rows).sum(axis=1, dtype=np.uint64)


def digest(found: np.ndarray, seed: int) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(found.tobytes(), seed)


def signed(docs: DataFrame, id_col: str, text_col: str, width: int, seed: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, h, node, fp, bands): h is a hash of the text, node a digest of its shingle set, so that texts with equal sets share it; fp the set's fingerprint."""
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    draw = np.random.Generator(np.random.Philox(seed))
    factors = draw.integers(0, 2**63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
    terms = draw.integers(0, 2**63, bands * rows, np.uint64)

    def of(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            nodes, fps, keys = [], [], [np.zeros(0, np.uint64)]
            for t in b["text"]:
                found = shingles(t.as_py(), width, seed)
                nodes.append(digest(found, seed))
                fps.append(majority(found))
                keys.append(band_keys(found, factors, terms, rows))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * bands, pa.int32()), pa.array(np.concatenate(keys).view(np.int64)))
            both = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (nodes, fps)]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["h"], *both, lists], ["doc_id", "h", "node", "fp", "bands"])

    return given.mapInArrow(of, "doc_id long, h long, node long, fp long, bands array<long>")


def shingle_sets(docs: DataFrame, wanted: DataFrame, text_col: str, width: int, seed: int) -> DataFrame:
    """(node, n, found) of the texts whose hash is in ``wanted.h``. Texts move once; only the wanted ones become sets."""
    texts = docs.select(F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text")).join(wanted, "h", "left_semi")

    def of(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                sets = [shingles(t.as_py(), width, seed) for t in whole["text"].slice(at, 500)]
                sizes = np.fromiter(map(len, sets), np.int64, len(sets))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
                nodes = np.array([digest(x, seed) for x in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(sizes), lists], ["node", "n", "found"])

    return texts.dropDuplicates(["h"]).select("text").mapInArrow(of, "node long, n long, found array<long>").dropDuplicates(["node"])


def cross_links(node: np.ndarray, comp: np.ndarray, sets: list[np.ndarray], least: float) -> Iterator[tuple[int, int]]:
    """Pairs of nodes in different components with Jaccard of ``least`` or more, one for each node outside the largest component and component it reaches."""
    names, comp, held = np.unique(comp, return_inverse=True, return_counts=True)
    if len(names) < 2:
        return
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, at, posted = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = owner[np.argsort(at, kind="stable")]
    begin, first = np.cumsum(posted) - posted, np.cumsum(sizes) - sizes
    for p in np.flatnonzero(comp != held.argmax()):
        own = at[first[p] : first[p] + sizes[p]]
        common = np.zeros(len(sets), np.int64)
        for s in own:
            common[owner[begin[s] : begin[s] + posted[s]]] += 1
        near = np.flatnonzero((common / (sizes + sizes[p] - common) >= least) & (comp != comp[p]))
        for q in near[np.unique(comp[near], return_index=True)[1]]:
            yield int(node[p]), int(node[q])


def shared_buckets(cells: DataFrame) -> DataFrame:
    """(bucket, node, fp, held, head) of the buckets of ``cells`` that hold several nodes; head is one of them, with its fingerprint."""
    heads = cells.groupBy("bucket").agg(F.count("*").alias("held"), F.min(F.struct(F.xxhash64("bucket", "node"), "node", "fp")).alias("head")).where("held > 1")
    return cells.join(heads, "bucket")


def links(sets: DataFrame, shared: DataFrame, least: float, radius: int, tile: int = 512) -> DataFrame:
    """(src, dst): links that span every group of nodes joined by steps of Jaccard ``least`` or more between nodes that share a bucket.

    First each node meets one node of each of its buckets. Buckets that hold several of the components so
    made are then searched whole, bit-sliced, but for pairs that are joined already: tiles of ``tile`` nodes of a bucket's largest
    component meet tiles of its other nodes, and these each other. A mass of like texts is thus joined by as many pairs as it
    has texts and buckets. Sets are fetched and compared only for fingerprints within ``radius`` bits.
    """
    near = shared.where((F.col("node") != F.col("head.node")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("head.fp"))) <= radius))
    pairs = near.select(F.least("node", "head.node").alias("src"), F.greatest("node", "head.node").alias("dst")).distinct()
    side = lambda name, k: sets.select(F.col("node").alias(name), F.col("n").alias(f"n{k}"), F.col("found").alias(f"found{k}"))
    both = pairs.join(side("src", 1), "src").join(side("dst", 2), "dst").where(F.least("n1", "n2") / F.greatest("n1", "n2") >= least)
    both = both.withColumn("common", F.size(F.array_intersect("found1", "found2")))
    starred = cut(both.where(F.col("common") / (F.col("n1") + F.col("n2") - F.col("common")) >= least).select("src", "dst"))
    parts = connected_components(starred).withColumnRenamed("component", "comp")
    placed = stored(shared.drop("head").join(parts, "node", "left").withColumn("comp", F.coalesce("comp", "node")))
    sizes = placed.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
    open_ = sizes.groupBy("bucket").agg(F.max(F.struct("n", "comp")).alias("main"), F.sum("n").alias("all"), F.count("*").alias("comps")).where("comps > 1")
    count = lambda n: F.greatest(F.lit(1), F.ceil(n / tile)).cast("int")
    open_ = open_.select("bucket", F.col("main.comp").alias("main"), count(F.col("main.n")).alias("tiles"), count(F.col("all") - F.col("main.n")).alias("rest"))
    rows = placed.join(open_, "bucket").withColumn("is_main", F.col("comp") == F.col("main"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("is_main"), F.col("tiles")).otherwise(F.col("rest"))).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cell = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"))
    across = F.transform(upto("tiles"), lambda i: cell(0, i, F.col("own")))
    among = F.transform(upto("rest"), lambda j: cell(1, F.least("own", j), F.greatest("own", j)))
    cells = F.when(F.col("is_main"), F.transform(upto("rest"), lambda j: cell(0, F.col("own"), j))).otherwise(F.concat(across, among))
    rows = rows.withColumn("cell", F.explode(cells))
    rows = rows.select("node", "comp", "fp", F.xxhash64("bucket", "cell").alias("bucket")).join(sets.select("node", "found"), "node")

    def compare(table):
        import pyarrow as pa

        table = table.combine_chunks()
        fps, comp = table["fp"].to_numpy().view(np.uint64), table["comp"].to_numpy()
        close = np.zeros(len(fps), bool)
        for i, j in within(fps, np.zeros(len(fps), np.int8), radius):
            apart = comp[i] != comp[j]
            close[i[apart]] = close[j[apart]] = True
        table = table.filter(pa.array(close))
        sets = [np.asarray(x.values) for x in table["found"]]
        out = np.array([*cross_links(table["node"].to_numpy(), comp[close], sets, least)], np.int64).reshape(-1, 2).T
        return pa.table([pa.array(out[0]), pa.array(out[1])], ["src", "dst"])

    return starred.union(rows.groupBy("bucket").applyInArrow(compare, "src long, dst long")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8,
                    radius: int = 26, seed: int = 42, bands: int = 32, rows: int = 4) -> DataFrame:
    """(doc_id, h, component_id, stays), one row for each row of ``docs``; h is Spark's xxhash64 of the text.

    Documents link when the Jaccard similarity of their sets of ``shingle``-word shingles is ``least`` or more;
    every link is decided on the sets. Pairs are compared when one of ``bands`` bands of ``rows`` least hashes is
    equal and their fingerprints differ in at most ``radius`` bits. A pair of similarity 0.8 is passed over by the bands with
    probability (1 - 0.8^4)^32, one in 20 million, and by the radius about as rarely (its bits differ with probability 0.15 each).
    component_id is the smallest doc_id that can be reached over links, its own included. stays: true for one
    (id, text) of each component, that of the smallest id, then of the smallest h.

    Null and blank texts are one set. Null ids get rows and join components without naming them; one
    stays only where its component has no id at all. Repeated rows repeat. An empty table gives no rows. Other columns
    are ignored.
    """
    rows_ = stored(signed(docs, id_col, text_col, shingle, seed, bands, rows))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h")).alias("first")
    distinct = cut(rows_.groupBy("node").agg(first, F.min("h").alias("h")))
    cells = rows_.select("node", "fp", F.posexplode("bands").alias("band", "key")).select("node", "fp", F.xxhash64("band", "key").alias("bucket")).distinct()
    shared = stored(shared_buckets(cells))
    wanted = cut(distinct.join(shared.select("node"), "node", "left_semi").select("h"))
    of = connected_components(links(stored(shingle_sets(docs, wanted, text_col, shingle, seed)), shared, least, radius))
    rooted = distinct.drop("h").join(of, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = rooted.groupBy("component").agg(F.min("first").alias("least"))
    named = cut(rooted.join(names, "component").select("node", "least"))
    stays = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("h") == F.col("least.h"))
    return rows_.select("doc_id", "h", "node").join(named, "node").select("doc_id", "h", F.col("least.doc_id").alias("component_id"), stays.alias("stays"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row of ``docs`` for each component of ``near_duplicates``, the one that stays, with all its columns.

    Rows are told by id and text, so other texts under the same id are judged by themselves; rows that repeat
    both stay once.
    """
    named = lambda i, h: F.concat_ws(" ", h, i.cast("string"))
    stay = near_duplicates(docs, id_col, text_col, **how).where("stays").select(named(F.col("doc_id"), F.col("h")).alias("key")).distinct()
    (key, turn) = own_names(docs, "key", "turn")
    keyed = docs.withColumn(key, named(F.col(id_col).cast("long"), F.xxhash64(text_col))).join(stay.withColumnRenamed("key", key), key, "left_semi")
    return keyed.withColumn(turn, F.row_number().over(W.partitionBy(key).orderBy(key))).where(F.col(turn) == 1).select(docs.columns)
