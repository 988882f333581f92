"""Scalar functions whose plain form differs between engines or raises, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cents(x: Column) -> Column:
    """Rounded to two digits as a double is, without going through its decimal form."""
    return F.round(x * 100) / 100


def iso_weekday(ts: Column) -> Column:
    """Sunday 0 to Saturday 6."""
    return (F.dayofweek(ts) - 1).cast("bigint")


def truncated(unit: str, ts: Column) -> Column:
    """date_trunc that stays a timestamp without a zone."""
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def safe_divide(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def jaccard(a: Column, b: Column) -> Column:
    """Shared by all distinct elements of two arrays; null if both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
