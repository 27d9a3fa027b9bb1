"""Column functions on vectors (ARRAY<FLOAT> or ARRAY<DOUBLE>); sums are in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwire.functions.text import let


def vec_dot(a: Column, b: Column) -> Column:
    """Null where either is null or the lengths differ."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(products, F.lit(0.0), lambda s, x: s + x))


def vec_norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def vec_normalize(a: Column) -> Column:
    """Length one; a zero vector stays."""
    return let(vec_norm(a), lambda n: F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double"))))


def clamp01(c: Column) -> Column:
    """Null stays null, which least and greatest would pass over."""
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def vec_weighted_mean(a: Column, wa: Column, b: Column, wb: Column) -> Column:
    total = wa.cast("double") + wb.cast("double")
    return F.zip_with(a, b, lambda x, y: (x.cast("double") * wa + y.cast("double") * wb) / total)
