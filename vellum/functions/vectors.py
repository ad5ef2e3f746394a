"""Column functions on vectors, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, epsilon: float = 0.0) -> Column:
    """Cosine similarity; ``epsilon`` keeps zero vectors from dividing by zero, else they give null."""
    below = norm(a) * norm(b) + epsilon
    return F.when(below != 0, dot(a, b) / below)


def of_dimension(a: Column, dimension: int) -> Column:
    """``a``, or an error if it hasn't ``dimension`` entries."""
    return F.when(F.size(a) == dimension, a).otherwise(F.raise_error(F.concat(F.lit("vector of dimension "), F.size(a).cast("string"))))


def as_text(a: Column) -> Column:
    """The written form, with eight decimals."""
    return F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: F.format_string("%.8f", x.cast("double"))), ","), F.lit("]"))
