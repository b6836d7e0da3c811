from pyspark.sql import functions as F

from calembour.operators import relational as R
from calembour.operators.skew import heavy_keys, hot_limit, salted_join


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_first_and_last(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, None), (None, 5, "n"), (None, 4, "m")], "k string, o int, v string")
    assert rows(R.first_per_key(df, "k", "o")) == sorted([("a", 1, None), (None, 4, "m")], key=repr)
    assert rows(R.last_per_key(df, "k", "v", "o")) == sorted([("a", "x"), (None, "n")], key=repr)


def test_group_lists(spark):
    df = spark.createDataFrame([("a", 1, None), ("b", 2, "3"), ("b", 1, "1")], "k string, o int, v string")
    assert rows(R.group_lists(df, "k", "o", ["v"])) == [("a", []), ("b", ["1", "3"])]


def test_numbered_counts_on_over_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("x")).repartition(7)
    got = R.numbered(df, ["x"]).orderBy("x").collect()
    assert [r["position"] for r in got] == list(range(1000))
    assert R.numbered(df.limit(0), ["x"]).count() == 0


def test_positional_zip_pads(spark):
    a, b = spark.createDataFrame([(3, "c"), (1, "a")], "i int, x string"), spark.createDataFrame([(9, "z")], "j int, y string")
    assert rows(R.positional_zip(a, b, ["i"], ["j"]).select("x", "y")) == [("a", "z"), ("c", None)]


def test_slices_and_shares(spark):
    df = spark.range(500)
    numbered = R.shuffled(df.withColumnRenamed("id", "k"), "k", seed=3)
    assert numbered.where("position < 474").count() == 474
    assert [r["id"] for r in R.chunked(df, "id", 100, 4, 9).select("id").orderBy("id").limit(1).collect()] == [400]
    s = R.shares(spark.createDataFrame([(None,), ("a",), ("a",)], "v string"), "v").collect()
    assert abs(sum(r["share"] for r in s) - 1) < 1e-12 and {r["v"] for r in s} == {"", "a"}
    assert R.stratified(spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "s string, k bigint"), "s", "k", 1).count() == 2


def test_salted_join_equals_a_plain_join(spark, monkeypatch):
    import calembour.operators.skew as skew

    monkeypatch.setattr(skew, "HOT_LEAST", 50)
    left = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert hot_limit(3000) == 50 and heavy_keys(right, ["k"], "n", 3000).collect()[0]["__splits"] == 20
    assert rows(salted_join(left, right, ["k"], "n", 3000, F.col("v"))) == rows(left.join(right, "k").select("k", "v", "n"))
