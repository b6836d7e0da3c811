"""Joins that stay balanced when one key holds a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with more than 1/HOT_FRACTION of all rows counts as hot, so there are fewer than HOT_FRACTION hot keys.
HOT_FRACTION = 500
#: Keys with fewer rows than this never count as hot, however small the table.
HOT_LEAST = 20_000


def hot_limit(total: int) -> int:
    return max(HOT_LEAST, total // HOT_FRACTION)


def heavy_keys(counts: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """Keys of ``counts`` (one row per key, ``n`` its rows) above the limit, with ``__splits``.

    At most HOT_FRACTION rows come out whatever the input's size, which is the proof
    that broadcasting the result is safe.
    """
    limit = hot_limit(total)
    return counts.where(F.col(n) > limit).select(*keys, F.ceil(F.col(n) / F.lit(limit)).cast("int").alias("__splits"))


def salted_join(rows: DataFrame, per_key: DataFrame, keys: list[str], n: str, total: int, spread: Column, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """Join ``rows`` with ``per_key`` (``n`` = the rows of its key in ``rows``).

    Rows of a hot key are spread over as many tasks as the key is times hotter than
    total/HOT_FRACTION, by ``spread`` (any column of ``rows`` that varies inside a key);
    the rows of ``per_key`` are repeated once per task. Other keys are not touched.
    ``counts`` (one row per key, with ``n``) is needed where ``per_key`` repeats keys.
    """
    limit = hot_limit(total)
    hot = F.broadcast(heavy_keys(per_key if counts is None else counts, keys, n, total))
    left = (
        rows.join(hot, keys, "left")
        .withColumn("__salt", F.when(F.col("__splits").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(spread), F.col("__splits").cast("bigint")).cast("int")))
        .drop("__splits")
    )
    splits = F.when(F.col(n) > limit, F.ceil(F.col(n) / F.lit(limit)).cast("int")).otherwise(F.lit(1))
    right = per_key.withColumn("__salt", F.explode(F.sequence(F.lit(0), splits - 1)))
    return left.join(right, [*keys, "__salt"], how).drop("__salt")
