"""Vector arithmetic on arrays, kept in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot_product(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot_product(a, a))


def l2_normalise(a: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    length = norm(a)
    return F.transform(a, lambda v: v.cast("double") / F.when(length > 0, length).otherwise(F.lit(1.0)))
