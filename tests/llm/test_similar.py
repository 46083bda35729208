"""The pipeline's near-duplicate stage against brute-force Jaccard similarity of 5-word shingles."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from quillspark.llm import similar

DDL = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def sets_of(t):
    w = [x for x in (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def leaders(rows):
    """Smallest id of each row's component, by comparing all pairs."""
    sets, part = [sets_of(t) for _, t in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if part[i] != part[j] and len(a & b) / len(a | b) >= 0.8:
                part = [part[j] if p == part[i] else p for p in part]
    return [min(r[0] for r, q in zip(rows, part, strict=True) if q == p) for p in part]


def test_stage_drops_pairs_of_similarity_at_least_0_8(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet").where(F.length("text") > 0)
    rows = sorted((r.doc_id, " ".join(r.text.split())) for r in docs.collect())
    want = [r[0] for r, least in zip(rows, leaders(rows), strict=True) if r[0] == least]
    # 177 and 145 have similarity 0.83 with 1 and 6, and fingerprints 11 and 7 bits away.
    assert not {177, 145} & set(want)
    assert sorted(r.doc_id for r in dict(cp.STAGES)["simhash_near_dedup"](spark, docs, "").collect()) == want


def test_near_copies(spark):
    rng = random.Random(4)
    base = [[rng.choice("abcdefghijklmnop") * rng.randrange(1, 5) for _ in range(n)] for n in (6, 40, 120, 300)]
    rows = [(1000, ""), (1001, "a b"), (1002, "A  b"), (1003, "a b c d e")]
    for i in range(160):
        w = list(base[i % 4])
        for _ in range(rng.randrange(1 + len(w) // 18)):
            w[rng.randrange(len(w))] = rng.choice("xyz")
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows] + [(None, "a b", "en", "a", 0)], DDL)
    want = sorted(zip([r[0] for r in rows], leaders(rows), strict=True))
    got = [(r.doc_id, r.component_id) for r in similar.near_duplicates(docs).collect()]
    assert sorted(x for x in got if x[0] is not None) == want and (None, 1001) in got
    assert similar.near_duplicates(docs.where("false")).count() == 0 and similar.drop_near_duplicates(docs.where("false")).count() == 0


def test_rows_are_dropped_by_id_and_text(spark):
    """An id with two texts, a repeated row, null ids, columns named like the operator's own."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(7, a), (7, b), (3, b), (9, a), (9, a), (None, c), (None, c + " c"), (5, b + " x"), (8, None), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({x: F.lit("x") for x in ("h", "node", "key", "turn", "stays", "component_id", "fp")})
    kept = similar.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted([(7, a), (3, b), (0, min(c, c + " c", key=lambda t: held(spark, t))), (2, "")])


def held(spark, text):
    return spark.range(1).select(F.xxhash64(F.lit(text)).alias("h")).first().h


def test_tiles_lose_no_link(spark):
    """A bucket that a star about one node cannot join: all in one bucket, linked as a chain."""
    rows = [(i, 20, list(range(i, i + 20))) for i in range(40)]
    sets = spark.createDataFrame(rows, "node long, n long, found array<long>")
    cells = sets.select("node", F.lit(5).cast("long").alias("fp"), F.lit(1).cast("long").alias("bucket"))
    found = similar.links(sets, similar.shared_buckets(cells), 0.9, 26, tile=5)
    from quillspark.operators.components import connected_components

    got = connected_components(found).select("component").distinct().collect()
    assert len(got) == 1 and got[0].component == 0
