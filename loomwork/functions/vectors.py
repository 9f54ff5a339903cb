"""Vector arithmetic on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: str | Column, b: str | Column) -> Column:
    """0 where a side has no length; null where a side is null or the lengths differ."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def unit(a: str | Column) -> Column:
    """The vector at length 1, null if it has none; normalise once, then compare by dot products. The squared length is
    bound by the aggregate's last step: named inside the transform it would be worked out again for every element."""
    scaled = lambda s: F.when(s > 0, F.transform(a, lambda x: x.cast("double") / F.sqrt(s)))
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"), scaled)
