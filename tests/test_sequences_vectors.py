import random

import pytest
from pyspark.sql import functions as F

from calembour.functions import sequences as S
from calembour.functions import vectors as V
from calembour.operators.vector_search import top_k, words_by_similarity


def test_padding_and_bigrams(spark):
    df = spark.createDataFrame([([5, None],)], "v array<int>")
    assert df.select(S.padded(F.col("v")).alias("p")).first()["p"] == [5] + [0] * 29
    g = spark.createDataFrame([(["t", "a"],)], "v array<string>").select(S.boundary_bigrams(F.col("v")).alias("g")).first()["g"]
    assert [tuple(x) for x in g] == [("BEG", "t"), ("t", "a"), ("a", "END")]


def table_score(a, b):
    d = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            s = len(set(x) & set(y)) / len(set(x) | set(y)) if x or y else 0.0
            d[i + 1][j + 1] = max(d[i][j] + s, d[i][j + 1], d[i + 1][j])
    return d[-1][-1] / max(len(a), len(b)) if a and b else 0.0


def test_alignment_against_the_full_table(spark):
    rng = random.Random(4)
    make = lambda: [[rng.choice("xyz") for _ in range(rng.randint(1, 3))] for _ in range(rng.randint(0, 6))]
    pairs = [(i, make(), make()) for i in range(40)] + [(40, [["x"], ["y"]], [["x"], ["y"]])]
    df = spark.createDataFrame(pairs, "i int, a array<array<string>>, b array<array<string>>")
    got = {r["i"]: r["s"] for r in df.select("i", S.alignment_score(F.col("a"), F.col("b"), S.jaccard).alias("s")).collect()}
    assert all(got[i] == pytest.approx(table_score(a, b)) for i, a, b in pairs) and got[40] == 1.0


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<float>, z array<float>")
    r = df.select(V.normalised(F.col("a")).alias("n"), V.normalised(F.col("z")).alias("z"), V.cosine(F.col("a"), F.col("z")).alias("c"), V.clamped(F.lit(-2.0)).alias("k")).first()
    assert r["n"] == pytest.approx([0.6, 0.8]) and r["z"] == [0.0, 0.0] and r["c"] is None and r["k"] == 0.0
    s = spark.createDataFrame([("a", "b", 3.0), ("a", "b", 25.0), ("a", "A ", None), (" ", "b", 9.0)], "a string, b string, w double")
    assert [r["s"] for r in s.select(V.capped_score(F.col("a"), F.col("b"), F.col("w")).alias("s")).collect()] == [0.3, 1.0, 1.0, 0.0]


def test_top_k(spark):
    rows = [(i, [float(i % 5), 1.0, float(i)]) for i in range(40)] + [(99, None)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    found = top_k(df, df.where("vec_id < 3"), k=4).collect()
    assert len(found) == 12 and all(r["query"] != r["neighbour"] for r in found)
    for q in range(3):
        scores = [r["score"] for r in sorted(found, key=lambda r: r["rank"]) if r["query"] == q]
        assert scores == sorted(scores, reverse=True) and all(abs(s) <= 1 + 1e-9 for s in scores)
    assert top_k(df.limit(2), df.limit(1), k=5).count() == 1
    assert top_k(df, df.limit(0)).count() == 0


def test_words_by_similarity_takes_a_word_s_last_row(spark):
    df = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "b", [0.0, 1.0]), (3, "a", [0.1, 1.0])], "vec_id bigint, word string, embedding array<float>")
    wanted = spark.createDataFrame([("a",), ("missing",)], "word string")
    assert words_by_similarity(df, wanted, k=1).first()["similar"] == "b"
