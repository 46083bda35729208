"""Packing tokenised documents into sequences of bounded length, balanced by attention cost."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from quillspark.llm.common import encoded

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def cost(length: int, hidden: int = 4096) -> float:
    """Of attention over ``length`` tokens, in units of a token's linear layers: 12 h^2 a token against 2 h a pair."""
    return length + length * length / (6 * hidden)


def balanced(lengths: list[int], size: int) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (item, start, length).

    Whole sequences are cut off the front of long items first. What is left goes, most costly first, to
    the sequence of lowest cost so far that has room for it; where none has, the item is cut over the
    cheapest sequences with room, largest room first. As many sequences are opened as the tokens need,
    so that less than one sequence is padding.
    """
    full = [[(i, s, size)] for i, n in enumerate(lengths) for s in range(0, n - n % size, size)]
    rest = sorted(((n % size, i, n - n % size) for i, n in enumerate(lengths) if n % size), key=lambda x: (-x[0], x[1]))
    bins: list[list[tuple[int, int, int]]] = [[] for _ in range(-(-sum(n for n, _, _ in rest) // size))]
    room = [size] * len(bins)
    open_bins = [(0.0, b) for b in range(len(bins))]
    for n, i, start in rest:
        aside = []
        while open_bins and room[open_bins[0][1]] < n:
            aside.append(heapq.heappop(open_bins))
        if open_bins:
            spent, b = heapq.heappop(open_bins)
            bins[b].append((i, start, n))
            room[b] -= n
            if room[b]:
                heapq.heappush(open_bins, (spent + cost(n), b))
        else:
            aside.sort(key=lambda x: (-room[x[1]], x))
            used = 0
            for at, (spent, b) in enumerate(aside):
                if used == n:
                    break
                take = min(room[b], n - used)
                bins[b].append((i, start + used, take))
                room[b] -= take
                used += take
                aside[at] = (spent + cost(take), b)
        for x in aside:
            if room[x[1]]:
                heapq.heappush(open_bins, x)
    return full + [b for b in bins if b]


def packed(docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text",
           group_rows: int = 1024, group_bytes: int = 8 << 20, seed: int = 5) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids), one row a piece.

    A document is the ids of its text (null: empty) and ``end_id``. Rows are dealt by a seeded hash into
    groups of about ``group_rows`` rows or ``group_bytes`` of text, whichever makes more groups; each is packed by
    itself (``balanced``), any number run at once, and less than one sequence a group is padding. sequence_id is group * 2^32 + place.
    Ids may be null or repeat; every row is a document of its own. An empty table gives no rows. Other
    columns are ignored. A document's ids are held in memory by one task.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    n_rows, n_bytes = rows.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    n_groups = max(1, -(-n_rows // group_rows), -(-(n_bytes or 0) // group_bytes))
    group = F.pmod(F.xxhash64(F.lit(seed), "doc_id", F.crc32("text")), F.lit(n_groups)).cast("long")
    end = end_id.to_bytes(4, "little")

    def tokens(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in (whole.slice(a, 1000) for whole in batches for a in range(0, whole.num_rows, 1000)):
            ids = [x + end for x in encoded(tokenizer_path, b["text"])]
            yield pa.RecordBatch.from_arrays([b["group"], b["doc_id"], pa.array(ids, pa.binary())], ["group", "doc_id", "ids"])

    def pack(table):
        import pyarrow as pa

        group = table["group"][0].as_py()
        held = sorted(zip(table["doc_id"].to_pylist(), table["ids"].to_pylist(), strict=True), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        out = []
        for k, sequence in enumerate(balanced([len(ids) // 4 for _, ids in held], size)):
            at = 0
            for i, start, n in sequence:
                doc_id, ids = held[i]
                piece = ids[4 * start : 4 * (start + n)]
                out.append((doc_id, start, n, zlib.crc32(piece), len(ids) // 4, (group << 32) + k, at, piece))
                at += n
        kinds = [pa.int64()] * 7 + [pa.binary()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[c.split()[0] for c in PIECES.split(", ")])

    rows = rows.select(group.alias("group"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(tokens, "group long, doc_id long, ids binary").groupBy("group").applyInArrow(pack, PIECES)
