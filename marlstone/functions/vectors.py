"""Vector functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in doubles; 0 where a norm is 0."""
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / F.when(size == 0, 1.0).otherwise(size))


def checked_dimension(a: Column, n: int) -> Column:
    """The vector, or null where it has not n numbers."""
    return F.when(F.size(a) == n, a)


def parse_embedding(text: Column) -> Column:
    """A JSON array as a vector; null where it isn't one."""
    return F.from_json(text, "array<double>")
