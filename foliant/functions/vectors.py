"""Vector arithmetic in double precision, as higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0).cast("double"), lambda s, x: s + x)


def norm(v: Column) -> Column:
    """The Euclidean length; a zero vector counts as length 1, so its cosine with all is 0."""
    length = F.sqrt(dot(v, v))
    return F.when(length == 0, F.lit(1.0)).otherwise(length)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))
