"""Column functions on arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def affine(values: Column, centre: Column, scale: Column) -> Column:
    """(values - centre) / scale, element by element."""
    return F.zip_with(F.zip_with(values, centre, lambda v, c: v - c), scale, lambda v, s: v / s)


def project(values: Column, basis: Column, scale: Column) -> Column:
    """Coordinates of values along the rows of basis, times scale."""
    return F.zip_with(F.transform(basis, lambda row: dot(values, row)), scale, lambda v, s: v * s)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where that is undefined."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
