"""Similarity of titles in hundredths: whole, by sorted tokens, by the best part, and the weighted best of these."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from quillspark.operators.resolve import indel_ratio


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter string with a stretch of the longer of its length or cut off at an end."""
    a, b = sorted((a, b), key=len)
    if not a:
        return 100.0 if not b else 0.0
    n = len(a)
    parts = [b[max(0, i) : i + n] for i in range(1 - n, len(b))]
    return max(indel_ratio(a, p) for p in parts)


def token_ratios(a: str, b: str, ratio) -> float:
    """Better of sorted tokens and of shared tokens with either rest."""
    x, y = a.split(), b.split()
    both, only_x, only_y = (" ".join(sorted(s)) for s in (set(x) & set(y), set(x) - set(y), set(y) - set(x)))
    if both and not (only_x and only_y):
        return 100.0
    left, right = f"{both} {only_x}".strip(), f"{both} {only_y}".strip()
    best = max(ratio(" ".join(sorted(x)), " ".join(sorted(y))), ratio(left, right))
    return max(best, ratio(both, left), ratio(both, right)) if both else best


def weighted_ratio(a: str, b: str) -> float:
    """Whole ratio, tokens at 0.95; where one string is 1.5 times as long also parts at 0.9, from 8 times at 0.6."""
    if not a or not b:
        return 0.0
    longer, shorter = max(len(a), len(b)), min(len(a), len(b))
    whole = indel_ratio(a, b)
    if longer / shorter < 1.5:
        return max(whole, 0.95 * token_ratios(a, b, indel_ratio))
    scale = 0.9 if longer / shorter <= 8 else 0.6
    return max(whole, scale * partial_ratio(a, b), 0.95 * scale * token_ratios(a, b, partial_ratio))


def best_match(df: DataFrame, title: str, id_col: str, wanted: str, cutoff: float = 50) -> DataFrame:
    """(id, title, ratio): the title most like ``wanted``, the smallest id on ties; no row below ``cutoff``.

    Each distinct title is scored once, in Arrow batches, in tasks that are as many as the session's cores allow several times over: titles are small rows that take long,
    which by their bytes would lie in few tasks. One aggregate reduces them.
    """
    spark = df.sparkSession

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            b["ratio"] = [weighted_ratio(wanted, t or "") for t in b["title"]]
            yield b[b["ratio"] >= cutoff]

    kind = df.schema[id_col].dataType.simpleString()
    once = df.groupBy(F.col(title).alias("title")).agg(F.max_by(id_col, -F.col(id_col)).alias("id")).select("id", "title")
    rows = once.repartition(4 * spark.sparkContext.defaultParallelism, "title").mapInPandas(run, f"id {kind}, title string, ratio double")
    return rows.agg(F.max_by(F.struct("id", "title", "ratio"), F.struct("ratio", -F.col("id"))).alias("r")).where("r is not null").select("r.*")
