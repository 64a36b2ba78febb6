"""Column functions on scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VECTOR_WEIGHT, KEYWORD_WEIGHT = 0.7, 0.3
LATE_WEIGHTS = (0.35, 0.35, 0.3)
K1, B, EMPTY_LENGTH = 1.2, 0.75, 500.0


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def bm25_term(weight: Column, tf: Column, length: Column, average: Column) -> Column:
    return weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def bm25_normalised(score: Column) -> Column:
    """Onto (0, 1); no match gives 0.5."""
    return 1 / (1 + F.exp(-0.1 * score))


def blended(vector: Column, keyword: Column, late: Column | None = None, weights: tuple[float, ...] | None = None) -> Column:
    """Weights are of vector and keyword score, or, with a late-interaction score, of vector, late and keyword score."""
    if late is None:
        a, b = weights or (VECTOR_WEIGHT, KEYWORD_WEIGHT)
        return a * vector + b * keyword
    a, b, c = weights or LATE_WEIGHTS
    return a * vector + b * late + c * keyword


def percent(score: Column) -> Column:
    """Truncated, not below 0."""
    return F.floor(F.greatest(score * 100, F.lit(0.0))).cast("long")


def band(score: Column) -> Column:
    return F.when(score >= 0.7, "high").when(score >= 0.4, "medium").otherwise("low")
