"""Vector arithmetic on array columns, in DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def squared_norm(v: Column) -> Column:
    return F.aggregate(as_doubles(v), F.lit(0.0), lambda acc, x: acc + x * x)


def unit(v: Column) -> Column:
    """Scale to length one; the zero vector stays zero."""
    norm = F.sqrt(squared_norm(v))
    return F.transform(as_doubles(v), lambda x: F.when(norm > 0, x / norm).otherwise(x))


def squared_l2(a: Column, b: Column) -> Column:
    gaps = F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: (x - y) * (x - y))
    return F.aggregate(gaps, F.lit(0.0), lambda acc, x: acc + x)
