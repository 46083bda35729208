"""Scores of papers as column arithmetic."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class Weights:
    citations: float = 1.0
    code: float = 1.0
    peer_reviewed: float = 1.0
    dataset: float = 1.0
    stars: float = 1.0


def _parts(w: Weights) -> dict[str, Column]:
    count = lambda c: F.log10(1 + F.coalesce(F.col(c), F.lit(0)).cast("double"))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("double")
    return {
        "citations": w.citations * count("citation_count"), "code": w.code * flag("has_public_code"), "peer_reviewed": w.peer_reviewed * flag("is_peer_reviewed"),
        "dataset": w.dataset * flag("has_dataset"), "stars": w.stars * count("repo_stars"),
    }


def composite_score(w: Weights = Weights()) -> Column:
    """Sum of the weighted parts (nulls count 0), rounded to 2 places."""
    parts = list(_parts(w).values())
    return F.round(sum(parts[1:], parts[0]), 2)


def score_breakdown(w: Weights = Weights(), places: int = 2) -> Column:
    """Struct of the parts, each rounded, and their rounded sum; may differ from ``composite_score`` by hundredths."""
    parts = {k: F.round(v, places) for k, v in _parts(w).items()}
    values = list(parts.values())
    return F.struct(*[v.alias(k) for k, v in parts.items()], F.round(sum(values[1:], values[0]), places).alias("score"))


def rep_score(citations: Column | str) -> Column:
    c = F.col(citations) if isinstance(citations, str) else citations
    return F.round(F.log10(1 + F.coalesce(c, F.lit(0)).cast("double")), 2)


def weights_from_json(raw: Column | str) -> Column:
    """Settings over their defaults; what cannot be parsed leaves the defaults."""
    given = F.from_json(raw, "citations double, code double, peer_reviewed double, dataset double, stars double")
    return F.struct(*[F.coalesce(given[k], F.lit(v)).alias(k) for k, v in Weights().__dict__.items()])


def middle_years(left: Column, right: Column) -> Column:
    """The year in the middle of a range, or the two of it."""
    total = left + right
    half = F.floor(total / 2).cast("int")
    return F.when(total % 2 == 0, F.array(half)).otherwise(F.array(half, half + 1))
