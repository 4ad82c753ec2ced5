"""Expressions over arrays of floats, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product. Arrays of different lengths give null."""
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(doubles(v), lambda x: x * x), F.lit(0.0), lambda s, x: s + x))


def unit(v: Column, least: float | None = None) -> Column:
    """v over its length; least: the length counts as this at least. A zero vector without least gives NaN everywhere."""
    length = F.greatest(norm(v), F.lit(least)) if least is not None else norm(v)
    return F.transform(F.array(length), lambda n: F.transform(doubles(v), lambda x: F.when(n == 0, F.lit(float("nan"))).otherwise(x / F.when(n == 0, F.lit(1.0)).otherwise(n))))[0]


def weighted_sum(vectors: Column, weights: Column) -> Column:
    """Sum of weight * vector over an array of vectors of one length."""
    scaled = F.zip_with(vectors, weights, lambda v, w: F.transform(doubles(v), lambda x: x * w))
    zero = F.transform(doubles(vectors[0]), lambda x: F.lit(0.0))
    return F.aggregate(scaled, zero, lambda s, v: F.zip_with(s, v, lambda x, y: x + y))


def first_or_null(items: Column) -> Column:
    return F.get(items, F.lit(0))
