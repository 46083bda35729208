"""Whitening against numpy's eigenvectors, chat formatting by round trips, collocations against plain counting."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import chat, collocations, whitening

CLASH = ("x", "c", "n", "i", "v", "one", "turns", "blocks", "segments", "f", "phrase", "range", "k", "a", "rank")


@pytest.mark.parametrize("values", [[3.0, 2, 1], [1.0] * 6, [5.0, 5, 5, 1, 1], [4.0, 3, 0, 0, 0], list(range(40)), [10.0**-i for i in range(30)], [1e-300, 0], [2.0]])
def test_components(values):
    n = len(values)
    q = np.linalg.qr(np.random.default_rng(n).standard_normal((n, n)))[0]
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    scale = max(np.abs(a).max() * n, 1e-300)
    for wanted in (None, 1, 4):
        got, vectors = whitening.components(a, wanted)
        assert len(got) == min(n, wanted or n) and np.abs(got - np.sort(values)[::-1][: len(got)]).max() <= 1e-14 * scale
        assert np.abs(vectors.T @ vectors - np.eye(len(got))).max() < 1e-13 and np.abs(a @ vectors - vectors * got).max() <= 1e-14 * scale


def test_whitened(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((90, 7)) * [9, 5, 4, 2, 1, 1, 1]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)] + [(3, [float(c) for c in base[0]])] * 60
    odd = [(None, [1.5, 2.0]), (200, None), (201, [1.0, None]), (202, [float("nan")] * 7), (203, [float("-inf")] * 7), (204, []), (205, [-0.001] * 7)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumns({c: F.lit("x") for c in CLASH}).repartition(5)
    kept = [(i, np.array([np.floor(256 * float(np.float32(c))) for c in v] + [0.0] * (7 - len(v)), np.int64)) for i, v in [*rows, odd[0], odd[5], odd[6]]]
    fit = np.unique([v for _, v in kept], axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    y = (n * fit - sums) / n
    cov = y.T @ y / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:4], vectors[:, ::-1][:, :4]
    got = whitening.whitened(table).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in got if r.component == 1) == sorted((i is None, i or 0) for i, _ in kept)
    for c in range(4):
        want = sorted((i if i is not None else -1, int(((n * v - sums) ** 2).sum()), float(((n * v - sums) / n) @ vectors[:, c] / np.sqrt(values[c]))) for i, v in kept)
        mine = sorted((r.vec_id if r.vec_id is not None else -1, r.deviation, r.whitened) for r in got if r.component == c + 1)
        assert [x[:2] for x in mine] == [x[:2] for x in want]
        if sum(a[2] * b[2] for a, b in zip(mine, want, strict=True)) < 0:
            want = sorted((i, d, -w) for i, d, w in want)
        assert np.abs(np.array([x[2] for x in mine]) - [x[2] for x in want]).max() < 1e-10
    assert {r.n for r in got} == {n} and {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-10
    assert all(abs(r.explained - values[r.component - 1] / np.trace(cov)) < 1e-12 for r in got)


def test_whitened_without_variance(spark):
    make = lambda rows: whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert make([]) == [] and make([(1, None)]) == [] and make([(1, [])]) == [] and make([(1, [1.0, 2.0])] * 3) == []
    line = make([(1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, [2.0, 2.0])])
    assert {r.component for r in line} == {1} and all(abs(r.explained - 1) < 1e-12 for r in line)
    assert all(r.deviation is None for r in make([(1, [0.0]), (2, [1e15])]))


def test_chat_round_trip(spark):
    rng = random.Random(1)
    parts = [*chat.CONTROL, "<", "[", "\\", "s>", "INST]", "]", ">", "a", " ", "\n", "é", "|", "TURN]", "[TURN", "$1", "\\E", "\x00"]
    rows = [(i // 7, i % 7, rng.choice(["user", "assistant", "system", "tool", "[TURN]x", "<|im_start|>", "", None]), "".join(rng.choice(parts) for _ in range(rng.randrange(9))) or None) for i in range(2100)]
    rows += [(None, 1, "user", "no id"), (900, None, "assistant", "late"), (900, None, "assistant", "late"), (900, 0, "user", None), (901, 0, "assistant", "x " * 50_000), *((902, t, "assistant", f"{t}") for t in range(600))]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in CLASH}).repartition(4)
    want = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((r or "", x or ""))
    for template in (chat.INSTRUCT, chat.CHATML):
        chats = chat.formatted(table, template)
        read = chats.select("conv_id", "formatted", "segments", chat.turns_of(F.col("formatted"), template).alias("turns"), chat.learned_of(F.col("segments")).alias("learned")).collect()
        assert len(read) == len(want)
        for r in read:
            turns = want[r.conv_id]
            assert [(t.role, t.text) for t in r.turns] == turns
            assert r.learned == "".join(x for role, x in turns if role == "assistant") and r.formatted == "".join(s.text for s in r.segments)
            assert len(r.segments) == 2 * len(turns) + len(list(itertools.groupby(turns, key=lambda t: t[0])))  # a text, what stands before it, and an end for each run of one role
        digest = {d.conv_id: d for d in chat.digests(chats, template).collect()}
        for c, turns in want.items():
            learned = "".join(x for role, x in turns if role == "assistant")
            d = digest[c]
            assert (d.n_turns, d.turns_sha256) == (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest())
            assert (d.loss_chars, d.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert chat.formatted(table.where("false")).count() == 0


def plain_collocations(docs, least, top, inside):
    pieces, n, f = [], Counter(), Counter()
    for text, lang in docs:
        text = (text or "").translate({i: i + 32 for i in range(65, 91)})
        pieces += [(lang or "und", [w for w in re.split("[ \t]+", p) if w]) for p in re.split("[.,;:!?\n\x0b\x0c\r]", text)]
    for lang, ws in pieces:
        n[lang] += len(ws)
        for k in (1, 2, 3, 4):
            f.update((lang, *ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = []
    for g, a in f.items():
        if len(g) > 2 and a >= least:
            cuts = [(2000000 * a // (f[g[: 1 + k]] + f[g[:1] + g[1 + k :]]), k) for k in range(1, len(g) - 1)]
            score, k = min(cuts)
            around = [h for h in f if h[0] == g[0] and len(h) > len(g) and f[h] >= least and any(h[i : i + len(g) - 1] == g[1:] for i in range(1, len(h)))]
            if not any(100 * f[h] >= inside * a for h in around):
                out.append((g[0], -score, -a, " ".join(g[1:]).encode(), f[g[: 1 + k]], f[g[:1] + g[1 + k :]]))
    out.sort()
    return [(lang, r, p.decode(), -a, left, right, n[lang], -s) for lang, rows in itertools.groupby(out, key=lambda x: x[0]) for r, (_, s, a, p, left, right) in enumerate(rows, 1) if r <= top]


@pytest.mark.parametrize("seed", range(3))
def test_collocations(spark, seed):
    rng = random.Random(seed)
    words = ["a", "b", "c", "the", "Of", "é", "x" * 3000, "d-e", "\x00", "a"]
    line = lambda: " ".join(rng.choice(words) + rng.choice(["", "", "", "", ",", ".", "\n", "\t", "  "]) for _ in range(rng.randrange(0, 40)))
    docs = [(line(), rng.choice(["en", "en", "en", "de", None, "und"])) for _ in range(60)] + [("p q r s t u v w x y. z", "en")] * 9 + [(None, "fr"), ("", "fr"), (" \t\n.", "fr"), ("once", "fr"), ("a b " * 4000, "long")]
    table = spark.createDataFrame(docs, "text string, lang string").withColumns({c: F.lit("x") for c in CLASH}).repartition(4)
    for how in ({}, {"ranges": 3, "batch_bytes": 200, "part_bytes": 4096}):
        got = sorted(map(tuple, collocations.collocations(table, 5, 25, 80, **how).collect()))
        assert got == sorted(plain_collocations(docs, 5, 25, 80))
    counts = {(r.lang, r.phrase): r.passage for r in collocations.passages(collocations.frequent(table, 5)).collect()}
    assert counts["en", "q r s t"] == counts["en", "u v w x"] == "p q r s t u v w x y"
    assert collocations.collocations(table.where("false")).count() == 0
