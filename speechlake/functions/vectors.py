"""Expressions over arrays of numbers, in double precision."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """The inner product of two arrays of one length."""
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(doubles(v), lambda x: x * x), F.lit(0.0), lambda s, x: s + x))


def normalized(v: Column, size: int | None = None) -> Column:
    """v at length 1; null where it is zero, has a number that is not finite, or is not of that size."""
    n = norm(v)
    good = n.isNotNull() & ~F.isnan(n) & (n > 0) & (n < float("inf"))
    if size is not None:
        good = good & (F.size(v) == size)
    return F.when(good, F.transform(doubles(v), lambda x: x / n))


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two arrays, kept within -1 and 1; null where either is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot(a, b) / n)))
