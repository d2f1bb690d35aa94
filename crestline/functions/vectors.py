"""Column expressions over ``array<double>`` vectors."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def centroid(v: Column) -> Column:
    """Index average weighted by magnitude (indexes start at 0)."""
    weighted = F.transform(v, lambda x, i: F.abs(x) * i)
    return F.try_divide(total(weighted), total(F.transform(v, F.abs)))


def flatness(power: Column) -> Column:
    """Geometric over arithmetic mean of a power spectrum, with a small floor."""
    floored = F.transform(power, lambda p: F.greatest(p, F.lit(1e-10)))
    n = F.size(power)
    return F.exp(total(F.transform(floored, F.ln)) / n) / (total(floored) / n)


def power(v: Column) -> Column:
    return F.transform(v, lambda x: x * x)


def share(v: Column, low: int, high: int) -> Column:
    """Share of the power that lies in bins ``low..high`` (0-based, both ends included)."""
    part = F.slice(v, low + 1, high - low + 1)
    return total(power(part)) / (total(power(v)) + 1e-12)
