"""Vectors as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalise(v: Column) -> Column:
    """To unit length; a zero vector stays."""
    return F.transform(v, lambda x: F.coalesce(F.try_divide(x.cast("double"), F.sqrt(dot(v, v))), F.lit(0.0)))


def truncate(v: Column, dims: int) -> Column:
    """The first dimensions, to unit length after the cut."""
    return normalise(F.slice(v, 1, dims))


def cosine(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))
