import pytest
from pyspark.sql import functions as F

from calembour.operators import metrics as M
from calembour.operators import panel


def test_weighted_scores(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "c"), ("b", "c")], "y string, p string")
    r = M.weighted_scores(df, "y", "p").first()
    assert (r["precision"], r["recall"], r["f1"]) == pytest.approx((1.0, 1 / 3, 4 / 9))
    assert M.accuracy(df, "y", "p").first()["accuracy"] == pytest.approx(r["recall"])
    assert M.weighted_scores(df.limit(0), "y", "p").first()["f1"] is None


def test_lists(spark):
    df = spark.createDataFrame([([0, 3, 5],), ([0, 0],), ([],)], "v array<int>")
    assert [r["m"] for r in df.select(M.nonzero_mean(F.col("v")).alias("m")).collect()] == [4.0, 0.0, 0.0]


def test_histograms(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)] + [(None,)], "x double")
    assert {r["bin"]: r["n"] for r in M.histogram(df, "x", 5).collect()} == {0: 2, 1: 2, 2: 2, 3: 2, 4: 3}
    assert {r["bin"]: r["n"] for r in M.unit_histogram(df, "x").collect()} == {0: 1, 1: 1, 2: 1, 3: 1, 4: 2}
    assert M.histogram(df.limit(0), "x").count() == 0


def trace(spark, rounds):
    rows = [("p", i, name, f"Rating: {r}\nJustification: j{i}") for i, given in enumerate(rounds, 1) for name, r in zip(panel.THRESHOLDS, given, strict=True) if r is not None]
    return spark.createDataFrame(rows, "id_en string, iteration int, evaluator string, response string")


@pytest.mark.parametrize(
    ("rounds", "want"),
    [
        ([(2, 2, 0, 4), (2, 2, 1, 3)], (1, 2.0, True)),
        ([(None, None, None, 4), (2, 2, 1, 4)], (1, 4.0, True)),
        ([(0, 0, 0, i) for i in range(5)] + [(2, 2, 1, 4)], (5, 1.0, False)),
        ([(2, 2, 1, 3), (2, 2, 1, 4)], (1, 2.0, True)),
    ],
)
def test_best_iteration(spark, rounds, want):
    r = panel.best_iteration(trace(spark, rounds)).first()
    assert (r["iteration"], r["best_score"], r["accepted"]) == want


def test_feedback_keeps_the_panel_order(spark):
    text = panel.feedback(trace(spark, [(1, 1, 1, 1)])).first()["feedback"]
    assert text == "KEY FEEDBACK:\n" + "\n\n".join(f"{n}: j1" for n in panel.THRESHOLDS)


def test_character_ids(spark):
    df = spark.createDataFrame([(2, "cb"), (1, "bab")], "o int, t string")
    assert {r["ch"]: r["id"] for r in M.character_ids(df, "t", "o").collect()} == {"b": 1, "a": 2, "c": 3}
