"""Vector similarity, in double precision over float arrays, without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(a, b)


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector has no length."""
    norm = F.sqrt(_sum(a, a)) * F.sqrt(_sum(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(_sum(a, b) / norm)
