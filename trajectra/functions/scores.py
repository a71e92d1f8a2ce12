"""Numeric functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """The inner product, summed in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def min_max(x: Column, low: Column, high: Column, eps: float = 1e-8) -> Column:
    """x scaled to 0..1; 0.5 if all values agree."""
    return F.when(high - low < eps, F.lit(0.5)).otherwise(F.try_divide(x - low, high - low))


def position_score(expected: Column, position: Column) -> Column:
    """How near a tool's mean position, 0.5 if unseen, is to a position."""
    return F.greatest(F.lit(0.0), 1.0 - F.abs(F.coalesce(expected, F.lit(0.5)) - position))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))

