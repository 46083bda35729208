"""Token ids in files of canonical, length-limited Huffman code.

A folder holds ``code`` (the code table), ``*.ids`` (documents in ascending order of id) and ``manifest``
(Parquet: one row a file, with the number of ids before it). All numbers are little-endian.

    code   "QCODE1\\0\\0", u32 limit, u32 n, then n bytes: the code length of ids 0 to n - 1, 0 for none
    *.ids  "QIDS1\\0\\0\\0", u32 block, u32 flags (1: a document without id), u64 documents, u64 ids, u64 blocks, u64 payload bytes,
           i64 a document (its id), u64 a document (its number of ids), u64 a block (checkpoint: its first bit), payload

Codes are canonical: shorter first, then by id. Each block of ``block`` ids starts at its checkpoint and
is decoded by itself: the next ``limit`` bits index a table of (id, length).
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from quillspark.llm.common import encoded
from quillspark.session import stored

CODE, IDS, HEAD = b"QCODE1\0\0", b"QIDS1\0\0\0", "<8sIIQQQQ"


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Lengths of an optimal prefix code with at most ``limit`` bits (package-merge); 0 where the count is 0."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    n = len(used)
    if n > 1 << limit:
        raise ValueError(f"{n} ids need more than {limit} bits")
    if n <= 1:
        out[used] = 1
        return out
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    level, kinds = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        half = len(level) // 2
        merged = np.concatenate((leaves, level[0 : 2 * half : 2] + level[1 : 2 * half : 2]))
        rank = np.argsort(merged, kind="stable")
        kinds.append(rank < n)
        level = merged[rank]
    lengths, take = np.zeros(n, np.uint8), 2 * n - 2
    for leaf in reversed(kinds):
        own = int(leaf[:take].sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    out[order] = lengths
    return out


class Code:
    """A canonical code: ``lengths`` by id, ``codes`` by id, and the decoding table."""

    def __init__(self, lengths: np.ndarray, limit: int) -> None:
        self.lengths, self.limit = lengths, limit
        ids = np.flatnonzero(lengths)
        ids = ids[np.lexsort((ids, lengths[ids]))]
        held = lengths[ids].astype(np.int64)
        steps = np.left_shift(1, limit - held)
        first = np.cumsum(steps) - steps  # in units of the longest code
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[ids] = (first >> (limit - held)).astype(np.uint64)
        self.symbol = np.zeros(1 << limit, np.uint32)
        self.length = np.zeros(1 << limit, np.int64)
        filled = int(steps.sum())
        self.symbol[:filled] = np.repeat(ids, steps)
        self.length[:filled] = np.repeat(held, steps)

    def to_bytes(self) -> bytes:
        return CODE + struct.pack("<II", self.limit, len(self.lengths)) + self.lengths.astype(np.uint8).tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Code:
        limit, n = struct.unpack_from("<II", raw, 8)
        if raw[:8] != CODE or len(raw) != 16 + n:
            raise ValueError("not a code table")
        return cls(np.frombuffer(raw, np.uint8, n, 16), limit)

    def encode(self, ids: np.ndarray, block: int, at_once: int = 1 << 16) -> tuple[bytes, np.ndarray]:
        """Payload and checkpoints. ``at_once`` ids are laid out together; each such part fills up its last 64-bit word."""
        parts, checkpoints, base = [], [], 0
        for a in range(0, len(ids), at_once - at_once % block or block):
            part = ids[a : a + (at_once - at_once % block or block)]
            size = self.lengths[part].astype(np.int64)
            if not size.all():
                raise ValueError("an id without a code")
            code = self.codes[part]
            start = np.cumsum(size) - size
            checkpoints.append(base + start[::block])
            word, room = start >> 6, 64 - (start & 63)
            spill = size - room
            over = np.flatnonzero(spill > 0)
            high = code << np.maximum(-spill, 0).astype(np.uint64) >> np.maximum(spill, 0).astype(np.uint64)
            begins = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            out = np.zeros(int(start[-1] + size[-1] + 63) >> 6, np.uint64)
            out[word[begins]] = np.add.reduceat(high, begins)
            out[word[over] + 1] += code[over] << (64 - spill[over]).astype(np.uint64)
            parts.append(out.astype(">u8").tobytes())
            base += 64 * len(out)
        return b"".join(parts), np.concatenate(checkpoints) if checkpoints else np.zeros(0, np.int64)

    def decode(self, payload: bytes, checkpoints: np.ndarray, block: int, n: int) -> np.ndarray:
        """All blocks side by side: step i reads the i-th id of every block."""
        words = np.concatenate((np.frombuffer(payload, ">u8").astype(np.uint64), np.zeros(2, np.uint64)))
        at, last = checkpoints.astype(np.int64), len(words) - 2
        out = np.empty((min(block, n), len(at)), np.uint32)
        down = np.uint64(64 - self.limit)
        for i in range(len(out)):
            word, bit = np.minimum(at >> 6, last), (at & 63).astype(np.uint64)
            ahead = (words[word] << bit | words[word + 1] >> np.uint64(1) >> (np.uint64(63) - bit)) >> down
            out[i] = self.symbol[ahead]
            at = at + self.length[ahead]
        return np.ascontiguousarray(out.T).ravel()[:n]


def pack_file(code: Code, doc_ids: list, sizes: np.ndarray, ids: np.ndarray, block: int) -> bytes:
    payload, checkpoints = code.encode(ids, block)
    named = np.array([x if x is not None else -(1 << 63) for x in doc_ids], "<i8")
    head = struct.pack(HEAD, IDS, block, int(None in doc_ids), len(named), len(ids), len(checkpoints), len(payload))
    return b"".join((head, named.tobytes(), sizes.astype("<u8").tobytes(), checkpoints.astype("<u8").tobytes(), payload))


def unpack_file(code: Code, raw: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """(document ids, sizes, ids) of a file."""
    magic, block, flags, docs, n, blocks, payload = struct.unpack_from(HEAD, raw)
    at = struct.calcsize(HEAD)
    if magic != IDS or len(raw) != at + 16 * docs + 8 * blocks + payload:
        raise ValueError("not a whole file of ids")
    named = np.frombuffer(raw, "<i8", docs, at).tolist()
    sizes = np.frombuffer(raw, "<u8", docs, at + 8 * docs).astype(np.int64)
    checkpoints = np.frombuffer(raw, "<u8", blocks, at + 16 * docs)
    if flags & 1:
        named = [None if x == -(1 << 63) else x for x in named]
    return named, sizes, code.decode(raw[len(raw) - payload :], checkpoints, block, n)


def store(folder: str):
    """(file system, path) of a folder on local, HDFS or object storage."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def put(folder: str, name: str, raw: bytes) -> None:
    """Writes under a name of its own first: a task that is run again replaces the whole file."""
    where, path = store(folder)
    where.create_dir(path, recursive=True)
    own = f"{path}/.{name}-{uuid.uuid4().hex}"
    with where.open_output_stream(own) as f:
        f.write(raw)
    where.move(own, f"{path}/{name}")


def get(folder: str, name: str) -> bytes:
    where, path = store(folder)
    with where.open_input_stream(f"{path}/{name}") as f:
        return f.read()


def added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sum of two arrays of counts of any lengths."""
    out = np.zeros(max(len(a), len(b)), np.int64)
    out[: len(a)] += a
    out[: len(b)] += b
    return out


CHUNK = "part int, chunk int, doc_ids array<long>, sizes array<long>, ids binary, counts binary"


def write_ids(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text",
              limit: int = 16, block: int = 256, file_ids: int = 1 << 19) -> None:
    """Tokenises whole texts (null: empty), appends ``end_id`` to each and writes the folder in ascending order of id.

    Rows are range-partitioned and sorted by id; a file holds consecutive documents of one partition with
    about ``file_ids`` ids (a longer document has a file of its own). Ids are kept as a table in the shared
    folder, so they are made once for the global counts and the files; each task's last row there holds its counts. Only counts by id (as many as the
    vocabulary has) and the code table go through the driver; files have names of their own and replace
    themselves when a task is run again. Null ids come first; rows of equal id stand side by side. An empty table gives a
    code table without codes and no file. Other columns are ignored.
    """
    spark, end = docs.sparkSession, end_id.to_bytes(4, "little")

    def chunks(batches: Iterator) -> Iterator:
        import pyarrow as pa

        part, chunk, held, size, counts = TaskContext.get().partitionId(), 0, [], 0, np.zeros(0, np.int64)
        pending, waiting = [], 0

        def row(last: bool):
            named, ids = zip(*held, strict=True)
            kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            values = [[part], [chunk], [named], [[len(x) // 4 for x in ids]], [b"".join(ids)], [counts.tobytes() if last else None]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], [c.split()[0] for c in CHUNK.split(", ")])

        for b in batches:
            for doc_id, ids in zip(b["doc_id"].to_pylist(), encoded(tokenizer_path, b["text"]), strict=True):
                if held and size + len(ids) > 4 * file_ids:
                    yield row(False)
                    chunk, held, size = chunk + 1, [], 0
                held.append((doc_id, ids + end))
                size += len(ids) + 4
                pending.append(held[-1][1])
                if (waiting := waiting + len(ids)) > 4 << 20:
                    counts, pending, waiting = added(counts, np.bincount(np.frombuffer(b"".join(pending), "<u4"))), [], 0
        if held:
            counts = added(counts, np.bincount(np.frombuffer(b"".join(pending), "<u4")))
            yield row(True)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.crc32("text"))
    made = stored(ordered.mapInArrow(chunks, CHUNK))

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(0, np.int64)
        for b in batches:
            for own in b["counts"]:
                total = added(total, np.frombuffer(own.as_buffer(), np.int64))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    tallied = made.where("counts is not null").select("counts").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r.id for r in tallied), default=-1) + 1, np.int64)
    counts[[r.id for r in tallied]] = [r.n for r in tallied]
    limit = max(limit, int(np.count_nonzero(counts) - 1).bit_length() if counts.any() else 1)
    code = Code(code_lengths(counts, limit), limit)
    put(folder, "code", code.to_bytes())
    lengths = code.lengths

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa

        code = Code(lengths, limit)
        for b in batches:
            for part, chunk, doc_ids, sizes, ids in zip(*b.columns, strict=True):
                name = f"{part.as_py():06d}-{chunk.as_py():06d}.ids"
                own = np.frombuffer(ids.as_buffer(), "<u4")
                put(folder, name, pack_file(code, doc_ids.as_py(), np.array(sizes.as_py()), own, block))
                yield pa.RecordBatch.from_arrays([pa.array([part.as_py()], pa.int32()), pa.array([name]), pa.array([len(own)])], ["part", "file", "n_ids"])

    files = stored(made.drop("counts").mapInArrow(write, "part int, file string, n_ids long"))
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", before(W.orderBy("part")).alias("earlier"))
    placed = files.withColumn("inside", before(W.partitionBy("part").orderBy("file"))).join(parts, "part")
    placed.select("file", "n_ids", (F.col("earlier") + F.col("inside")).alias("start")).write.mode("overwrite").parquet(f"{folder}/manifest")


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from a folder: start counts the ids of all documents before, ids are little-endian uint32."""
    files = spark.read.parquet(f"{folder}/manifest")
    tasks = max(1, min(files.count(), 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        code = None
        for b in batches:
            for name, start in zip(b["file"].to_pylist(), b["start"].to_pylist(), strict=True):
                code = code or Code.from_bytes(get(folder, "code"))
                named, sizes, ids = unpack_file(code, get(folder, name))
                ends = np.cumsum(sizes)
                cuts = pa.array(np.concatenate(([0], 4 * ends)).astype(np.int64))
                held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, cuts.buffers()[1], pa.py_buffer(ids.astype("<u4").tobytes())])
                columns = [pa.array(named, pa.int64()), pa.array(start + ends - sizes), pa.array(sizes), held.cast(pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids"])

    return files.select("file", "start").repartition(tasks).mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")
