"""Vector functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.text import col


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product in double; the cosine of unit vectors."""
    products = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def geometric_mean(a: Column | str, b: Column | str) -> Column:
    a, b = col(a), col(b)
    return F.when((a > 0) & (b > 0), F.sqrt(a * b)).otherwise(0.0)


def minus_relative_distance(x: Column | str, target: float) -> Column:
    return -F.abs(col(x) - target) / target


def linear_score(weights: dict[str, float]) -> Column:
    """Sum of weight times column; zero weights are skipped, so their columns may be missing."""
    out = F.lit(0.0)
    for name, w in weights.items():
        if w:
            out = out + F.lit(float(w)) * F.col(name)
    return out
