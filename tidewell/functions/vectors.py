"""Distances between vector columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Distances are rounded before ranking so that the summation order of an
# engine cannot decide which of two equally near rows comes first.
DISTANCE_PLACES = 9


def as_floats(vector: Column) -> Column:
    """The single-precision form vectors are stored and compared in."""
    return vector.cast("array<float>")


def squared_l2(left: Column, right: Column) -> Column:
    """Squared Euclidean distance, in double, by direct differences."""
    squares = F.zip_with(
        left, right, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))
    )
    total = F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x)
    return F.round(total, DISTANCE_PLACES)


def l2(left: Column, right: Column) -> Column:
    return F.sqrt(squared_l2(left, right))
