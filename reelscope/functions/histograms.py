"""Histograms of hue, saturation and value, and their distance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BINS = 32


def value_bin(v: Column) -> Column:
    return F.floor(v * BINS / 256).cast("int")


def hue_saturation_bin(h: Column, s: Column) -> Column:
    return (F.floor(h * BINS / 180) * BINS + F.floor(s * BINS / 256)).cast("int")


def is_night(mean_v: Column, mean_s: Column, dark: float = 40.0, grey: float = 20.0) -> Column:
    return (mean_v < dark) | (mean_s < grey)


def min_max(h: Column) -> Column:
    """Counts scaled to 0 to 1; a constant histogram becomes all zero."""
    low, high = F.array_min(h), F.array_max(h)
    return F.transform(h, lambda c: F.coalesce(F.try_divide((c - low).cast("double"), (high - low).cast("double")), F.lit(0.0)))


def bhattacharyya(a: Column, b: Column) -> Column:
    """Distance of two histograms of one length, 0 to 1; 1 where either has no mass."""
    total = lambda h: F.aggregate(h, F.lit(0.0), lambda s, x: s + x)
    shared = F.aggregate(F.zip_with(a, b, lambda x, y: F.sqrt(x * y)), F.lit(0.0), lambda s, x: s + x)
    mass = F.sqrt(total(a) * total(b))
    return F.sqrt(F.greatest(F.lit(0.0), 1 - F.coalesce(F.try_divide(shared, mass), F.lit(0.0))))
