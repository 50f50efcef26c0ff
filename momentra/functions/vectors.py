"""Vector columns over ``array<double>``; every element is a double before it is multiplied."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    return F.element_at(F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: F.when(n > 1e-12, x / n).otherwise(F.lit(0.0)))), 1)


def truncate(a: Column, dim: int) -> Column:
    """The first ``dim`` components, renormalised."""
    return l2_normalize(F.slice(a, 1, dim))


def interpolate(base: Column, tuned: Column, alpha: float) -> Column:
    return F.zip_with(base, tuned, lambda x, y: F.lit(1 - alpha) * x + F.lit(alpha) * y)


def mean_vector(v: str, dim: int) -> Column:
    """Element-wise mean as an aggregate expression: one buffer a group, no exploded rows."""
    return F.array(*[F.avg(F.get(F.col(v), F.lit(i))) for i in range(dim)])
