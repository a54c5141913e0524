"""Vector columns and the small formulas of the mining operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 if either is the zero vector."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def cosine_distance(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(2.0), 1 - cosine_similarity(a, b)))


def sigmoid(x: Column) -> Column:
    """Without overflow on either side."""
    small = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + small)).otherwise(small / (1 + small))


def pairs_of(n: Column) -> Column:
    return n * (n - 1) / 2


def inverse_frequency(n_docs: Column, in_docs: Column) -> Column:
    return F.log((1 + n_docs) / (1 + in_docs)) + 1
