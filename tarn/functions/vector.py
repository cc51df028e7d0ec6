"""Vector functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _dot(a: Column, b: Column) -> Column:
    # zip_with pads the shorter array with nulls; a missing element adds nothing
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, 0 if either has length zero; over the elements both have, with the lengths of the whole arrays."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    lengths = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(lengths == 0, F.lit(0.0)).otherwise(_dot(a, b) / lengths)
