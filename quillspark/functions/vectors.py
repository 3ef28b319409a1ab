"""Vector arithmetic on array<float> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_norm(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if the sizes differ or a vector is null or zero."""
    n = F.sqrt(squared_norm(a)) * F.sqrt(squared_norm(b))
    return F.coalesce(F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n), F.lit(0.0))


def normalise(a: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    n = F.sqrt(squared_norm(a))
    return F.when(n > 0, F.transform(a, lambda x: (x / n).cast("float"))).otherwise(a)
