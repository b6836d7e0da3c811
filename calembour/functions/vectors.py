"""Vector expressions on ARRAY columns, summed in DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalised(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = norm(v)
    return F.transform(_d(v), lambda x: F.when(n == 0, x).otherwise(x / n))


def cosine(a: Column, b: Column) -> Column:
    """Null for a zero vector."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def mean(vectors: Column) -> Column:
    """The mean of a list of vectors; null for an empty list."""
    rest = F.slice(vectors, F.lit(2), F.greatest(F.size(vectors) - 1, F.lit(0)))
    total = F.aggregate(rest, _d(F.get(vectors, F.lit(0))), lambda a, v: F.zip_with(a, _d(v), lambda x, y: x + y))
    return F.transform(total, lambda x: x / F.size(vectors))


def clamped(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def joined_lists(word: Column, *lists: Column) -> Column:
    """``word`` and then the lists' items."""
    return F.concat(F.array(word), *lists)


def capped_score(word: Column, other: Column, weight: Column, scale: float = 10.0) -> Column:
    """weight/scale, at most 1; equal words 1, blank ones 0."""
    return (
        F.when((F.trim(word) == "") | (F.trim(other) == ""), 0.0)
        .when(F.lower(F.trim(word)) == F.lower(F.trim(other)), 1.0)
        .otherwise(F.least(F.lit(1.0), F.coalesce(weight, F.lit(0.0)) / scale))
    )
