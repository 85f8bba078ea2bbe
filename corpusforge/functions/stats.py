"""Numeric functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Agreement bands, first inclusive match (fixed values).
BANDS = ((0.0, 0.2, "slight"), (0.2, 0.4, "fair"), (0.4, 0.6, "moderate"), (0.6, 0.8, "substantial"), (0.8, 1.0, "almost perfect"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def f1(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def band(k: Column) -> Column:
    out = None
    for low, high, name in BANDS:
        hit = (k >= low) & (k <= high)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("—")


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function by a five-term rational approximation (error below 1e-7)."""
    t = 1 / (1 + 0.2316419 * F.abs(x))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-x * x / 2) / F.sqrt(F.lit(6.283185307179586)) * poly
    return F.when(x >= 0, 1 - upper).otherwise(upper)


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(250.0)), F.lit(-250.0))))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))
