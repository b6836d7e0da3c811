"""Order-aware relational operators. Every one names its order column; nothing relies on file order."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calembour.session import checkpointed


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the least ``order`` of each key (null is a key); all columns.

    An aggregate with a partial step, not a window: a key that fills a third of the
    table is reduced before it is shuffled.
    """
    rest = [c for c in df.columns if c != key]
    picked = df.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("__row"))
    return picked.select(key, "__row.*").select(*df.columns)


def last_per_key(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """``key`` and the ``value`` with the greatest ``order``."""
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))


def ordered_list(value: Column, order: Column) -> Column:
    """Aggregate: the non-null values in the order of ``order``; all-null groups give an empty list."""
    rows = F.collect_list(F.when(value.isNotNull(), F.struct(order.alias("o"), value.alias("v"))))
    return F.transform(F.array_sort(rows), lambda r: r["v"])


def group_lists(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """One row per key with the columns as lists. The list of a key is one value of one row by definition; where keys
    may be huge, keep the long form with ``numbered`` instead."""
    return df.groupBy(key).agg(*(ordered_list(F.col(c), F.col(order)).alias(c) for c in columns))


def numbered(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """``df`` with positions 0, 1, ... in the order of ``order`` over the whole table, without a single-task sort.

    Range partitions are sorted and counted on their own; only the counts (one per
    partition) meet.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id())
    fixed = checkpointed(ranged)
    sizes = fixed.groupBy("__part").agg(F.count(F.lit(1)).alias("n"), F.min("__row").alias("__start"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("__before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    return fixed.join(F.broadcast(starts), "__part").withColumn(name, F.col("__before") + F.col("__row") - F.col("__start")).drop("__part", "__row", "__start", "__before")


def positional_zip(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str]) -> DataFrame:
    """Rows side by side by position; the shorter side is padded with nulls."""
    return numbered(left, left_order).join(numbered(right, right_order), "position", "full")


def not_done(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return df.join(done.select(key).distinct(), key, "left_anti")


def per_key_limit(df: DataFrame, keys: list[str], order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows of each key; the engine limits each partition before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= limit).drop("__rank")


def shares(df: DataFrame, column: str) -> DataFrame:
    """``column``, ``n`` and ``share`` of all rows; a missing value is the category ''."""
    counts = df.groupBy(F.coalesce(F.col(column), F.lit("")).alias(column)).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def portable_order(key: str) -> Column:
    """A scattered order that every engine computes alike."""
    return F.pmod(F.col(key) * 7919, F.lit(10007))


def stratified(df: DataFrame, stratum: str, key: str, size: int) -> DataFrame:
    """``size`` rows of each stratum in the scattered order; fewer where there are fewer."""
    return per_key_limit(df, [stratum], [portable_order(key), F.col(key)], size)


def shuffled(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """``df`` numbered in a seeded random order."""
    return numbered(df.withColumn("__h", F.xxhash64(F.lit(seed), key)), ["__h", key]).drop("__h")


def sliced(df: DataFrame, order: list[str], ranges: list[tuple[int, int]]) -> DataFrame:
    """Rows at the positions ``start`` to ``end`` - 1 of each range, in the order of ``order``; ``position`` is kept."""
    at = F.col("position")
    return numbered(df, order).where(reduce(or_, [(at >= a) & (at < b) for a, b in ranges], F.lit(False)))


def random_pairs(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows of both sides drawn without replacement and put side by side, in the scattered order of their keys; the longer side's rest is left out."""
    a = numbered(left.withColumn("__o", portable_order(left_key)), ["__o", left_key]).drop("__o")
    b = numbered(right.withColumn("__o", portable_order(right_key)), ["__o", right_key]).drop("__o")
    return a.join(b, "position").drop("position")


def chunked(df: DataFrame, order: str, size: int, start: int = 0, end: int = -1) -> DataFrame:
    """``df`` with ``chunk_id`` = order div size, chunks ``start`` to ``end`` (-1: all; beyond the last: as far as there are any)."""
    out = df.withColumn("chunk_id", F.floor(F.col(order) / size).cast("int"))
    return out.where(F.col("chunk_id") >= start) if end < 0 else out.where(F.col("chunk_id").between(start, end))
