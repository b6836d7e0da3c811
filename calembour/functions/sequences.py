"""Segment sequences: padding, boundary bigrams, feature sets, alignment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def padded(ids: Column, size: int = 30) -> Column:
    """The first ``size`` ids, zeros behind them; unknown (null) ids become 0."""
    known = F.transform(ids, lambda x: F.coalesce(x, F.lit(0)))
    return F.slice(F.concat(known, F.array_repeat(F.lit(0), size)), 1, size)


def boundary_bigrams(segments: Column) -> Column:
    """Adjacent pairs of BEG, the segments, END as structs (a, b)."""
    whole = F.concat(F.array(F.lit("BEG")), segments, F.array(F.lit("END")))
    n = F.size(whole)
    return F.zip_with(F.slice(whole, F.lit(1), n - 1), F.slice(whole, F.lit(2), n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def signs(features: Column) -> Column:
    """``+``, ``-``, ``0`` of a feature row as 1, -1, 0."""
    return F.transform(features, lambda x: F.when(x == "+", 1).when(x == "-", -1).otherwise(0))


def positive_names(names: list[str], features: Column) -> Column:
    """Names of the features marked ``+``; boundary marks have one of their own."""
    return F.filter(F.array(*(F.when(features[i] == "+", F.lit(n)) for i, n in enumerate(names))), lambda x: x.isNotNull())


def jaccard(a: Column, b: Column) -> Column:
    """|a and b| / |a or b|, 0 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def alignment_score(a: Column, b: Column, similarity) -> Column:
    """Best total similarity of an order-keeping alignment of two arrays, over the longer length; gaps cost nothing.

    One fold per row of the table of partial scores; each row is itself a fold that
    carries (row so far, diagonal). ``similarity(x, y)`` is a column expression.
    """
    zero = F.transform(F.concat(F.array(F.lit(0)), F.transform(b, lambda _: F.lit(0))), lambda _: F.lit(0.0))

    def next_row(above: Column, x: Column) -> Column:
        cells = F.sequence(F.lit(0), F.size(b) - 1)
        return F.aggregate(
            cells,
            F.array(F.lit(0.0)),
            lambda row, j: F.concat(row, F.array(F.greatest(F.element_at(above, j + 1) + similarity(x, F.element_at(b, j + 1)), F.element_at(above, j + 2), F.element_at(row, -1)))),
        )

    total = F.element_at(F.aggregate(a, zero, next_row), -1)
    longest = F.greatest(F.size(a), F.size(b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(total / longest)
