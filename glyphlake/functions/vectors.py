"""Vectors as arrays: norm, scale, inner product, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST_NORM = 1e-8


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def norm(v: Column) -> Column:
    return F.greatest(F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda a, x: a + x * x)), F.lit(LEAST_NORM))


def scaled(v: Column) -> Column:
    """v at length 1."""
    return F.transform(doubles(v), lambda x: x / norm(v))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
