"""Vector functions as column expressions; sums in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero. Of unequal lengths the shorter one counts, but a's norm is that of its whole."""
    shorter = lambda v, w: F.when(F.size(v) > F.size(w), F.slice(v, 1, F.size(w))).otherwise(v)
    b = shorter(b, a)
    length = norm(a) * norm(b)
    return F.when(length == 0, F.lit(0.0)).otherwise(dot(shorter(a, b), b) / length)


def normalize(v: Column) -> Column:
    """Scaled to length 1 in single precision; a zero vector stays as it is."""
    length = norm(v)
    return F.when(length > 0, F.transform(v, lambda x: (x / length).cast("float"))).otherwise(v)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
