"""Column functions on vectors (arrays of float or double), computed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """0 where a side is null, empty or zero, or the lengths differ."""
    usable = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    length = norm(a) * norm(b)
    return F.coalesce(F.when(usable & (length > 0), dot(a, b) / F.nullif(length, F.lit(0.0))), F.lit(0.0))


def normalised(a: Column) -> Column:
    """Of length 1; a zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def fused(a: Column, b: Column, how: str = "weighted", alpha: float = 0.4) -> Column:
    """Two embeddings of a text as one of length 1.

    weighted: alpha * a + (1 - alpha) * b; max: element-wise; mean; adaptive: weighted by absolute values.
    """
    d = lambda x: x.cast("double")
    rules = {
        "weighted": lambda x, y: alpha * d(x) + (1 - alpha) * d(y),
        "max": lambda x, y: F.greatest(d(x), d(y)),
        "mean": lambda x, y: (d(x) + d(y)) / 2,
        "adaptive": lambda x, y: (F.abs(d(x)) * d(x) + F.abs(d(y)) * d(y)) / (F.abs(d(x)) + F.abs(d(y)) + 1e-8),
    }
    return normalised(F.zip_with(a, b, rules[how]))
