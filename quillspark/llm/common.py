"""What several operators share: text folding, word counts, byte-level tokenising."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word: a longest run of characters other than space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"


def fold(text: Column) -> Column:
    """``text`` (null: empty) with A-Z in lower case and nothing else changed.

    lower() does just that to pure ASCII, and much faster than translate(); other texts take translate().
    """
    text = F.coalesce(text, F.lit(""))
    return F.when(F.char_length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def own_names(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lean_worker() -> None:
    """Lets this Python worker give large arrays back to the system as soon as they are freed, where the C library can be told so: idle workers then hold little."""
    import contextlib
    import ctypes

    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD, fixed


class PieceTokenizer:
    """Ids of whole texts by a byte-level BPE of the tokenizers library, as little-endian uint32 bytes.

    Such a tokenizer cuts a text into pieces before it merges bytes: before a blank that a non-blank follows
    (of a run of blanks, before the run and before its last one), and between a letter and the punctuation after
    it. A text's ids are those of its pieces in turn. Distinct pieces are encoded once and kept until more than
    ``keep`` are held. Texts that spell a special token, end in two blanks or hold the cutting mark go to
    the library whole.
    """

    BLANK = r"[\t-\r \x{85}\p{Z}]"
    WHOLE = r"[\x00\x1c-\x1f]|" + BLANK + BLANK + r"\z"
    #: A Latin letter and ASCII punctuation other than the apostrophe.
    CLOSING = r"([A-Za-zÀ-ÖØ-öø-ÿ])([!-&(-/:-@\[-`{-~])"
    #: Pieces of letters alone, and pieces that are encoded by themselves: beyond one leading space they begin or end with a blank, or are empty.
    LETTERS = r"\A ?[A-Za-zÀ-ÖØ-öø-ÿ]+\z"
    ODD = r"\A ?\z|\A ?" + BLANK + "|" + BLANK + r"\z"

    def __init__(self, path: str, keep: int = 300_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        from tokenizers import Tokenizer

        self.of = Tokenizer.from_file(path)
        self.model = Tokenizer(self.of.model)  # merges alone, for pieces that need no further cutting
        if hasattr(self.of.model, "_resize_cache"):
            self.of.model._resize_cache(0)  # each piece comes once
        self.special = [t.content for t in self.of.get_added_tokens_decoder().values()]
        self.keep = keep
        # Byte-level BPE spells bytes as characters: printable ones as they are, the others from 256 on.
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = iter(range(256, 512))
        self.spelling = np.array([x if x in plain else next(others) for x in range(256)], "<u4")
        line_end = self.whole("\n")
        self.line_end = int.from_bytes(line_end, "little") if len(line_end) == 4 else None
        self.forget()

    def forget(self) -> None:
        import numpy as np
        import pyarrow as pa

        self.known = pa.array([""])
        self.ends, self.ids = np.zeros(2, np.int64), np.zeros(0, "<u4")  # piece i has ids[ends[i] : ends[i + 1]]

    def whole(self, text: str) -> bytes:
        import numpy as np

        return np.array(self.of.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def lines(self, pieces, spelled: bool):
        """(ids, their number by piece) of an Arrow array of pieces encoded together, a line each."""
        import numpy as np
        import pyarrow.compute as pc

        if not len(pieces):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        lined = pc.binary_join_element_wise(pieces, "", "\n")
        at = np.frombuffer(lined.buffers()[1], np.int32)[lined.offset : lined.offset + len(lined) + 1]
        raw = np.frombuffer(lined.buffers()[2], np.uint8)[at[0] : at[-1]]
        cuts = np.append(at[:-1][:: 256 if spelled else 20_000], at[-1]) - at[0]
        if spelled:  # letters are one piece for the tokenizer too, so its merges take them as they are
            texts = [self.spelling[raw[a:b]].tobytes().decode("utf-32-le") for a, b in zip(cuts, cuts[1:], strict=False)]
            got = self.model.encode_batch_fast(texts, add_special_tokens=False)
        else:
            texts = [raw[a:b].tobytes().decode() + "." for a, b in zip(cuts, cuts[1:], strict=False)]
            got = self.of.encode_batch_fast(texts, add_special_tokens=False)
        ids = np.concatenate([np.array(x.ids[: None if spelled else -1], "<u4") for x in got])
        ends = np.flatnonzero(ids == self.line_end)
        if len(ends) != len(pieces):
            raise ValueError("the vocabulary merges a line end with what is beside it")
        return ids[ids != self.line_end], np.diff(ends, prepend=-1) - 1

    def learn(self, pieces):
        """Places in ``known`` that the pieces of an Arrow array have from now on."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        told = lambda pattern: pc.match_substring_regex(pieces, pattern).to_numpy(zero_copy_only=False)
        letters = told(self.LETTERS) if self.line_end is not None else np.zeros(len(pieces), bool)
        odd = ~letters & (told(self.ODD) if self.line_end is not None else True)
        kinds = np.where(letters, 0, np.where(odd, 2, 1))
        order = np.argsort(kinds, kind="stable")
        pieces = pieces.take(pa.array(order))
        n, m = int(letters.sum()), int(len(pieces) - odd.sum())
        ids, sizes = self.lines(pieces[:n], True)
        more, widths = self.lines(pieces[n:m], False)
        odd_ids = [np.frombuffer(self.whole(p), "<u4") for p in pieces[m:].to_pylist()]
        base = len(self.known)
        self.known = pa.concat_arrays([self.known, pieces])
        self.ids = np.concatenate([self.ids, ids, more, *odd_ids])
        held = np.concatenate([sizes, widths, np.fromiter(map(len, odd_ids), np.int64, len(odd_ids))])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(held)])
        places = np.empty(len(order), np.int64)
        places[order] = base + np.arange(len(order))
        return places

    def encode(self, texts) -> list[bytes]:
        """Ids of each text of an Arrow array. No piece becomes a Python object; ids are put together by place."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, self.WHOLE)
        for t in self.special:
            whole = pc.or_(whole, pc.match_substring(texts, t))
        cut = pc.if_else(whole, "", texts)
        if pc.any(pc.match_substring_regex(cut, self.BLANK + self.BLANK)).as_py():
            cut = pc.replace_substring_regex(cut, f"({self.BLANK}*)({self.BLANK})", "\x00\\1\x00\\2")
            cut = pc.replace_substring_regex(cut, r"\x00\n([^\x00\t-\r \x{85}\p{Z}])", "\x00\n\x00\\1")
        else:
            cut = pc.replace_substring(pc.replace_substring(cut, " ", "\x00 "), "\n", "\x00\n\x00")
        cut = pc.split_pattern(pc.replace_substring_regex(cut, self.CLOSING, "\\1\x00\\2"), "\x00")
        begins = cut.offsets.to_numpy()
        coded = cut.flatten().dictionary_encode()
        if len(self.known) > self.keep:
            self.forget()
        at = pc.fill_null(pc.index_in(coded.dictionary, value_set=self.known), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            at[new] = self.learn(coded.dictionary.take(pa.array(new)))
        held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.known), [None, pa.py_buffer(4 * self.ends), pa.py_buffer(self.ids)])
        out = held.take(pa.array(at[coded.indices.to_numpy()]))
        raw = memoryview(out.buffers()[2] or b"")
        ends = np.frombuffer(out.buffers()[1], np.int64)[begins].tolist()
        return [self.whole(t.as_py()) if w else bytes(raw[a:b]) for t, w, a, b in zip(texts, whole.to_pylist(), ends, ends[1:], strict=False)]


_made: dict[str, PieceTokenizer] = {}


def tokenizer(path: str) -> PieceTokenizer:
    """One for each Python worker and file, kept between tasks."""
    if path not in _made:
        _made[path] = PieceTokenizer(path)
    return _made[path]


def encoded(path: str, texts, at_once: int = 2 << 20) -> Iterator[bytes]:
    """Ids of each text of an Arrow array; texts of about ``at_once`` bytes are looked up together."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + at_once, side="right")))
        yield from tokenizer(path).encode(texts[a:b])
        a = b
    pa.default_memory_pool().release_unused()  # a worker lives on, beside others
