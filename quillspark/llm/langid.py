"""Language identification by cross-parsing entropy over suffix automata."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

UNKNOWN = "und"
#: Languages whose counts are broadcast at most.
MOST_BROADCAST = 10_000
#: In a transition, marks that the phrase before this character has ended.
ENDS = 1 << 30
_GAPS = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]+")


def spelled(text: str) -> bytes:
    """Lower-cased UTF-8 in which every run of ASCII characters other than letters is one space."""
    return _GAPS.sub(b" ", text.lower().encode())


class Automaton:
    """The suffix automaton of a training text as a dense table of (state, byte class).

    A transition that the automaton lacks leads to where the byte leads from the root, marked ENDS: the
    longest match ends before that byte and the next phrase begins with it. A byte that the training text
    lacks is a phrase of its own; it leads to a last state, the start too, from which every byte begins a phrase.
    """

    def __init__(self, training: bytes) -> None:
        used = sorted(set(training))
        self.classes = np.zeros(256, np.uint8)
        self.classes[used] = np.arange(1, len(used) + 1)
        width = len(used) + 1
        link, length, to = [-1], [0], [{}]
        last = 0
        for c in self.classes[np.frombuffer(training, np.uint8)].tolist():
            new = len(to)
            link.append(0)
            length.append(length[last] + 1)
            to.append({})
            p = last
            while p >= 0 and c not in to[p]:
                to[p][c] = new
                p = link[p]
            if p >= 0:
                q = to[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    clone = len(to)
                    link.append(link[q])
                    length.append(length[p] + 1)
                    to.append(dict(to[q]))
                    while p >= 0 and to[p].get(c) == q:
                        to[p][c] = clone
                        p = link[p]
                    link[q] = link[new] = clone
            last = new
        self.start = len(to) * width
        root = np.array([to[0].get(c, len(to)) for c in range(width)], np.int64) * width
        table = np.tile(root | ENDS, (len(to) + 1, 1)).astype(np.int32)
        for state, out in enumerate(to):
            for c, q in out.items():
                table[state, c] = q * width
        self.table = table.ravel()
        self.bits = math.log2(max(2, len(training)))  # to name a place in the training text

    def phrases(self, padded: np.ndarray, lanes: np.ndarray) -> np.ndarray:
        """Phrases of each column of ``padded`` (steps by segments, longest segments first); lanes: segments alive at each step."""
        at = np.full(padded.shape[1], self.start, np.int32)
        n = np.zeros(padded.shape[1], np.int64)
        table, classes = self.table, self.classes
        for step, live in enumerate(lanes.tolist()):
            went = table[at[:live] + classes[padded[step, :live]]]
            n[:live] += went >> 30
            at[:live] = went & (ENDS - 1)
        return n


@lru_cache(maxsize=1)
def automata(samples: tuple[tuple[str, bytes], ...]) -> list[tuple[str, Automaton]]:
    return [(lang, Automaton(text)) for lang, text in samples]


def costs(texts: list[bytes], of: list[tuple[str, Automaton]], segment: int = 512) -> np.ndarray:
    """Bits a byte (texts by languages): phrases of the cross-parsing, each named by its place. Parsing begins anew every ``segment`` bytes."""
    sizes = np.array([len(t) for t in texts], np.int64)
    parts = -(-sizes // segment)
    owner = np.repeat(np.arange(len(texts)), parts)
    begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    start = begins[owner] + nth * segment
    length = np.minimum(segment, sizes[owner] - nth * segment)
    order = np.argsort(-length, kind="stable")
    start, length, owner = start[order], length[order], owner[order]
    everything = np.concatenate((np.frombuffer(b"".join(texts), np.uint8), np.zeros(segment, np.uint8)))
    found = np.zeros((len(texts), len(of)))
    for a in range(0, len(start), 8192):
        s, n = start[a : a + 8192], length[a : a + 8192]
        steps = np.arange(n[0] if len(n) else 0)
        padded = everything[steps[:, None] + s[None, :]]
        lanes = np.searchsorted(-n, -steps, side="left")  # segments longer than each step
        for k, (_, automaton) in enumerate(of):
            found[:, k] += np.bincount(owner[a : a + 8192], automaton.phrases(padded, lanes), len(texts))
    return found * np.array([x.bits for _, x in of]) / np.maximum(1, sizes)[:, None]


def training_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, held_out: Column, docs_per_lang: int, train_bytes: int) -> DataFrame:
    """(lang, h, piece) of labelled rows outside ``held_out`` that have a letter: about ``docs_per_lang`` a language, drawn by hash of the id.

    A piece comes from the middle of its text; the fewer rows a language has, the longer it is, so that together they can fill ``train_bytes``.
    """
    able = docs.where(~held_out & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    rows = able.select(F.col(lang_col).alias("lang"), F.xxhash64(F.lit(3), F.col(id_col)).alias("h"), F.col(text_col).alias("text"))
    counts = rows.groupBy("lang").count()
    few = counts.limit(MOST_BROADCAST + 1).collect()
    if len(few) <= MOST_BROADCAST:  # else Spark shuffles both sides
        counts = F.broadcast(docs.sparkSession.createDataFrame(few, counts.schema))
    drawn = F.shiftrightunsigned("h", 12).cast("double") * F.col("count") < F.lit(1.25 * docs_per_lang + 8) * float(1 << 52)
    long = F.greatest(F.lit(256), F.ceil(F.lit(2 * train_bytes) / F.col("count"))).cast("int")
    middle = F.greatest(F.lit(1), F.floor((F.char_length("text") - long) / 2)).cast("int")
    return rows.join(counts, "lang").where(drawn).select("lang", "h", F.substring(F.col("text"), middle, long).alias("piece"))


def learn(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          docs_per_lang: int = 256, train_bytes: int = 32_768) -> tuple[tuple[str, bytes], ...]:
    """(lang, training text) by code point of the language.

    The classifier's sample is bounded: from each language about ``docs_per_lang`` labelled documents, a
    piece from the middle of each, ``train_bytes`` bytes in all; a language with few documents gives longer pieces of them.
    That bound (and the number of languages) is all that reaches the driver.
    """
    by: dict[str, list[tuple[int, bytes]]] = {}
    for lang, h, piece in training_rows(docs, id_col, text_col, lang_col, held_out, docs_per_lang, train_bytes).collect():
        by.setdefault(lang, []).append((h, spelled(piece)))
    out = []
    for lang, pieces in sorted(by.items(), key=lambda x: x[0].encode()):
        text, left = [], train_bytes
        for k, (_, p) in enumerate(sorted(pieces)):
            text.append(p[: max(16, left // (len(pieces) - k))])  # what short pieces leave, later ones may take
            left -= len(text[-1])
        out.append((lang, b"".join(text)[:train_bytes]))
    return tuple(out)


def identified(docs: DataFrame, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
               carry: tuple[str, ...] = (), **how) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) and the columns named in ``carry``, one row for each row of ``docs``.

    Learns from text and label of the rows outside ``held_out`` (none: all rows); a prediction uses the
    text alone. Each text is parsed whole, into longest phrases that occur in a language's training text; the language with the fewest phrases, each
    weighed by the bits that name its place, wins, ties by code point. score: 1 less the winner's bits over
    the runner-up's (1.0 if only one language is known).

    lang_pred is ``und`` and score 0 for null texts, texts without a letter, and where no language was learned.
    Rows whose label is null teach nothing; a null id is never held out. Repeated rows repeat. An empty
    table gives no rows.
    """
    held = F.coalesce(held_out, F.lit(False)) if held_out is not None else F.lit(False)
    samples = learn(docs, held, id_col, text_col, lang_col, **how)
    kinds = {f.name: f for f in docs.schema.fields}
    rows = docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("__letter"),
                       F.col(text_col).alias("__text"), *carry)
    kept = ["doc_id", "held_out", *carry]
    schema = rows.select(*kept).withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema
    assert all(c in kinds for c in carry)

    def predict(batches: Iterator) -> Iterator:
        import pyarrow as pa

        of = automata(samples)
        for b in batches:
            text, letter = b["__text"], b["__letter"].to_pylist()
            langs, scores = [UNKNOWN] * b.num_rows, [0.0] * b.num_rows
            rows, some, size = [], [], 0
            for i in range(b.num_rows + 1):
                if some and (i == b.num_rows or size > 4 << 20):
                    bits = costs(some, of)
                    best = bits.argmin(axis=1)
                    for r, row, k in zip(rows, bits, best.tolist(), strict=True):
                        langs[r] = of[k][0]
                        second = min([x for j, x in enumerate(row.tolist()) if j != k], default=math.inf)
                        scores[r] = max(0.0, 1 - float(row[k]) / second)
                    rows, some, size = [], [], 0
                if i < b.num_rows and letter[i] and of:
                    rows.append(i)
                    some.append(spelled(text[i].as_py()))
                    size += len(some[-1])
            columns = [b[c] for c in kept] + [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "lang_pred", "score"])

    return rows.mapInArrow(predict, schema)
