"""Metric aggregates. Each returns a small DataFrame, nothing is printed or collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def accuracy(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Share of rows where both agree, case aside."""
    same = F.lower(F.coalesce(F.col(truth), F.lit(""))) == F.lower(F.coalesce(F.col(predicted), F.lit("")))
    return df.agg(F.avg(same.cast("int")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def weighted_scores(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Support-weighted precision, recall and F1.

    A class that was never predicted has no precision, one without support no recall;
    such classes leave numerator and denominator alike. Recall therefore equals accuracy.
    """
    counted = df.groupBy(F.coalesce(F.col(truth), F.lit("")).alias("y"), F.coalesce(F.col(predicted), F.lit("")).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = counted.select(F.inline(F.array(
        F.struct(F.col("y").alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("hits")),
        F.struct(F.col("p").alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("hits")),
    )))
    per = sides.groupBy("label").agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits"))
    weight = F.col("support")
    precision = F.sum(F.when(F.col("predicted") > 0, F.col("hits") / F.col("predicted") * weight))
    f1 = F.sum(2 * F.col("hits") / (weight + F.col("predicted")) * weight)
    return per.agg(
        F.try_divide(precision, F.sum(F.when(F.col("predicted") > 0, weight))).alias("precision"),
        F.try_divide(F.sum(F.col("hits").cast("double")), F.sum(weight)).alias("recall"),
        F.try_divide(f1, F.sum(weight)).alias("f1"),
    )


def similarity_summary(df: DataFrame, similarity: str, problems: str | None = None) -> DataFrame:
    """Mean, population variance, rows above 0.75 and below 0.25 and their shares, problems."""
    s = F.col(similarity)
    total = F.count(F.lit(1))
    out = [
        F.avg(s).alias("mean"),
        F.var_pop(s).alias("variance"),
        F.count_if(s > 0.75).alias("n_gt_075"),
        F.try_divide(F.count_if(s > 0.75), total).alias("share_gt_075"),
        F.count_if(s < 0.25).alias("n_lt_025"),
        F.try_divide(F.count_if(s < 0.25), total).alias("share_lt_025"),
    ]
    if problems:
        out += [F.sum(problems).alias("problems"), F.try_divide(F.sum(problems), total).alias("problem_share")]
    return df.agg(*out)


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Equal bins from the least to the greatest value, the last one closed: ``bin``, ``n``. Nulls are left out."""
    present = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("x"))
    whole = present.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).withColumn("one", F.lit(1))
    counted = present.groupBy("x").agg(F.count(F.lit(1)).alias("n")).withColumn("one", F.lit(1)).join(F.broadcast(whole), "one")  # whole: one row
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col("x") - F.col("lo")) / width), F.lit(bins - 1)))
    return counted.groupBy(at.cast("int").alias("bin")).agg(F.sum("n").alias("n"))


def unit_histogram(df: DataFrame, column: str, top: int = 5) -> DataFrame:
    """Unit bins 0..top, the last one closed; values outside are left out."""
    return df.where(F.col(column).between(0, top)).groupBy(F.least(F.floor(column), F.lit(top - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def list_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a + x)


def nonzero_mean(values: Column) -> Column:
    """Sum over the number of non-zero items; 0 when the sum isn't positive."""
    total = list_sum(values)
    return F.when(total > 0, total / F.size(F.filter(values, lambda x: x != 0))).otherwise(0.0)


def item_frequency(df: DataFrame, lists: Column, name: str = "item") -> DataFrame:
    """Occurrences of the non-blank items of a list column."""
    return df.select(F.explode(lists).alias(name)).where(F.trim(name) != "").groupBy(name).agg(F.count(F.lit(1)).alias("n"))


def mean_pooled(df: DataFrame, key: str, vector: str) -> DataFrame:
    """The mean vector of each key."""
    parts = df.select(key, F.posexplode(vector).alias("i", "x")).groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return parts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda r: r["x"]).alias(vector))


def character_ids(df: DataFrame, text: str, order: str) -> DataFrame:
    """``ch``, ``id``: ids from 1 in the order in which characters first occur (by ``order``, then position)."""
    chars = df.select(F.col(order).alias("o"), F.posexplode(F.split(text, "")).alias("i", "ch")).where("ch <> ''")
    first = chars.groupBy("ch").agg(F.min(F.struct("o", "i")).alias("at"), F.count(F.lit(1)).alias("n"))
    # one row per character of the alphabet
    return first.select("ch", F.row_number().over(Window.orderBy("at")).alias("id"), "n")
