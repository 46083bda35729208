"""Near-duplicates by SimHash: fingerprints within a radius, found by bit-sliced comparison."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from quillspark.operators.components import connected_components
from quillspark.session import cut, stored

BITS = 64


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Of lower-cased (A-Z) words: bit i is 1 if set in over half of the shingles' XXH64; no words: 0."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # bytes split at space and \t \n \v \f \r
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(joined, seed)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    starts, ends = starts[: -(shingle - 1) or None].tolist(), ends[shingle - 1 :].tolist()
    hashes = np.fromiter((xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, ends, strict=True)), np.uint64, len(starts))
    return majority(hashes)


def majority(hashes: np.ndarray, at_once: int = 65_536) -> int:
    """The fingerprint of ``hashes``: bit i is 1 if set in over half of them."""
    set_in = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), at_once):
        set_in += np.unpackbits(hashes[at : at + at_once].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_in > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): fp is the 64-bit fingerprint as a signed long."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def of(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle, seed) for t in b["text"]], np.uint64)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return rows.mapInArrow(of, "doc_id long, fp long")


def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes stored vertically: row b holds bit b of every fingerprint, 64 lanes a word, one word to spare."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    words = -(-len(fps) // 64)
    wide = np.zeros((64 * (words + 1), BITS), np.uint8)
    wide[: len(fps)] = bits
    return np.packbits(np.ascontiguousarray(wide.T), axis=1, bitorder="little").view("<u8")


def within(fps: np.ndarray, buckets: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of places in one bucket whose fingerprints differ in at most ``radius`` bits, some at a time.

    ``buckets`` is sorted. Step k compares every lane with the lane k further on: the planes are XORed
    with their shifted selves and added plane by plane into carry-save counters, a bit of 64 distances a
    word. After every eight planes the words all of whose lanes exceed the radius are abandoned.
    """
    size = np.diff(np.flatnonzero(np.concatenate(([True], buckets[1:] != buckets[:-1], [True]))))
    sizes = np.repeat(size, size)
    places = np.arange(len(fps))
    depth = (radius + 1).bit_length()
    order = np.argsort(np.random.Generator(np.random.Philox(7)).random(BITS))
    k, held = 1, -1
    while True:
        keep = sizes > k
        if not keep.any():
            return
        if held < 0 or 2 * keep.sum() < held:  # most buckets are done: go on with the others' lanes
            fps, buckets, sizes, places = fps[keep], buckets[keep], sizes[keep], places[keep]
            held, sliced = len(fps), planes(fps)
        n, skip, by = len(fps), k // 64, np.uint64(k % 64)
        same = np.zeros(64 * (sliced.shape[1] - 1), bool)
        same[: max(0, n - k)] = buckets[: max(0, n - k)] == buckets[k:]
        valid = np.packbits(same, bitorder="little").view("<u8")
        live = np.flatnonzero(valid)
        valid = valid[live]
        count = [np.zeros(len(live), np.uint64) for _ in range(depth)]
        over = np.zeros(len(live), np.uint64)
        far = over
        for step in range(0, BITS, 8):
            if not len(live):
                break
            ahead = np.minimum(live + skip, sliced.shape[1] - 1), np.minimum(live + skip + 1, sliced.shape[1] - 1)
            for b in order[step : step + 8]:
                plane = sliced[b]
                there = plane[ahead[0]] >> by
                if by:
                    there = there | (plane[ahead[1]] << (np.uint64(64) - by))
                carry = plane[live] ^ there
                for at in range(depth):
                    count[at], carry = count[at] ^ carry, count[at] & carry
                over |= carry
            far = over | exceeds(count, radius)
            left = (valid & ~far) != 0
            if not left.all():
                live, valid, over, far = live[left], valid[left], over[left], far[left]
                count = [c[left] for c in count]
        if len(live):
            bits = np.unpackbits((valid & ~far).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            word, lane = np.nonzero(bits)
            i = live[word] * 64 + lane
            yield places[i], places[i + k]
        k += 1


def exceeds(count: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter, least significant plane first, is over ``radius``."""
    over = np.zeros_like(count[0])
    equal = ~over
    for at in reversed(range(len(count))):
        if radius >> at & 1:
            equal = equal & count[at]
        else:
            over = over | (equal & count[at])
            equal = equal & ~count[at]
    return over


def spanning(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """Of ``pairs``, those that join two parts not yet joined: n - 1 at most."""
    root, joined = np.arange(n), []
    for i, j in pairs:
        new = root[i] != root[j]
        if not new.any():
            continue
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = y
            return x

        for a, b in zip(i[new].tolist(), j[new].tolist(), strict=True):
            x, y = top(int(root[a])), top(int(root[b]))
            if x != y:
                up[max(x, y)] = min(x, y)
                joined.append((a, b))
        moved = np.arange(n)
        for x in up:
            moved[x] = top(x)
        root = moved[root]
    return joined


def links(fps: DataFrame, radius: int = 2, parts: int = 4, tile: int = 8192) -> DataFrame:
    """(src, dst): links that span every group of distinct values of ``fps.fp`` joined by steps of at most ``radius`` bits.

    Two such fingerprints agree in ``parts - radius`` of ``parts`` equal parts at least. For each choice of
    so many parts, the fingerprints that agree there form a bucket and are compared with each other. A
    bucket of over ``tile`` values is cut into tiles; every pair of tiles is a bucket of its own then, so
    that no task holds more than two tiles of one bucket.
    """
    width = BITS // parts
    part = [F.shiftrightunsigned("fp", width * p).bitwiseAND(F.lit((1 << width) - 1)) for p in range(parts)]
    keys = [F.struct(F.lit(k).alias("choice"), F.xxhash64(F.lit(k), *[part[p] for p in chosen]).alias("key"))
            for k, chosen in enumerate(combinations(range(parts), parts - radius))]
    cells = fps.select("fp", F.inline(F.array(*keys)))
    hot = cells.groupBy("choice", "key").count().where(F.col("count") > tile)
    hot = hot.select("choice", "key", F.ceil(F.col("count") / tile).cast("int").alias("tiles"))
    cells = cells.join(hot, ["choice", "key"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    cells = cells.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    cells = cells.select("fp", F.xxhash64("choice", "key", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"))

    def compare(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held = [(b["fp"].to_numpy(), b["bucket"].to_numpy()) for b in batches if b.num_rows]
        if not held:
            return
        fp, bucket = map(np.concatenate, zip(*held, strict=True))
        order = np.lexsort((fp, bucket))
        fp, bucket = fp[order], bucket[order]
        once = np.concatenate(([True], (fp[1:] != fp[:-1]) | (bucket[1:] != bucket[:-1])))
        fp, bucket = fp[once], bucket[once]
        found = spanning(len(fp), within(fp.view(np.uint64), bucket, radius))
        i, j = np.array(found, np.int64).reshape(-1, 2).T
        yield pa.RecordBatch.from_arrays([pa.array(fp[i]), pa.array(fp[j])], ["src", "dst"])

    return cells.repartition("bucket").mapInArrow(compare, "src long, dst long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row for each row of ``docs``.

    Fingerprints link at ``radius`` or fewer differing bits; component_id is the smallest doc_id that can
    be reached over links, its own included. Equal fingerprints meet once (smallest id kept), so copies
    are never compared. Null and blank texts have fingerprint 0 and link like any other. Null ids get
    rows and join components without naming them (component_id is null if no member has an id). Repeated
    rows repeat. An empty table gives no rows. Other columns are ignored.
    """
    rows = stored(fingerprints(docs, id_col, text_col, shingle, seed))
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    of = connected_components(links(distinct, radius)).select(F.col("node").alias("fp"), F.col("component"))
    rooted = distinct.join(of, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    names = rooted.groupBy("component").agg(F.min("least").alias("component_id"))
    named = cut(rooted.join(names, "component").select("fp", "component_id"))
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
