import random

import pytest
from pyspark.sql import functions as F

from calembour.llm import lookalikes as L

SCORES = L.Scores({p: 9 for w in ("^the$", "^ocean$", "^cop$", "^café$", "^один$", "^пар$", "^хор$") for p in (w[i : i + 2] for i in range(len(w) - 1))})


@pytest.mark.parametrize(
    "dressed",
    ["The осеаn", "Ｔｈｅ ｏｃｅａｎ", "The ocean", "T​he oc­ean⁠", "﻿The  οcean ", "Тhe ocean"],
)
def test_equal_looks_get_one_form(dressed):
    assert SCORES.canonical(dressed) == "The ocean"


def test_what_differs_to_the_eye_stays():
    for a, b in (("The ocean", "the ocean"), ("cafe", "café"), ("a, b", "a; b"), ("a b", "b a"), ("x2", "x²")):
        assert SCORES.canonical(a) != SCORES.canonical(b)
    assert SCORES.canonical("café") == SCORES.canonical("саfé") == "café"
    assert SCORES.canonical("один пар") == "один пар"
    assert SCORES.canonical("ﬁne") == "fine"
    assert SCORES.canonical(None) is None and SCORES.canonical(" ​ ") == ""


def brute(rows, canonical):
    out = set()
    for i, a in rows:
        for j, b in rows:
            if i < j and a is not None and b is not None and a != b and canonical(a) == canonical(b) != "":
                out.add((i, j))
    return out


def test_pairs_against_brute_force(spark, monkeypatch):
    import calembour.operators.skew as skew

    monkeypatch.setattr(skew, "HOT_LEAST", 10)
    rng = random.Random(3)
    base = ["the ocean", "a cop", "café au lait", "une note"]
    rows = [(i, "the ocean") for i in range(60)]
    for i in range(60, 120):
        t = rng.choice(base)
        for a, b in rng.sample([("o", "о"), ("a", "а"), ("e", "е"), (" ", " "), ("n", "​n"), ("c", "ｃ")], 2):
            t = t.replace(a, b) if rng.random() < 0.5 else t
        rows.append((i, t))
    rows += [(200, None), (201, ""), (202, "​")]
    df = spark.createDataFrame(rows, "ord bigint, text_clean string").withColumn("canonical", F.lit("clash"))
    scores = L.train(df, "text_clean")
    got = [tuple(r) for r in L.same_looking_pairs(df, "ord", "text_clean", scores).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, scores.canonical)
    assert L.same_looking_pairs(df.limit(0), "ord", "text_clean").count() == 0


def test_a_long_text():
    assert len(SCORES.canonical("осеаn " * 50_000)) == 6 * 50_000 - 1


def test_parts_are_kept_apart(spark):
    rows = [(1, "x", "a cop"), (2, "x", "a сор"), (1, "y", "a сор"), (3, "y", "a cop")]
    df = spark.createDataFrame(rows, "ord bigint, f string, t string")
    got = sorted(tuple(r) for r in L.same_looking_pairs(df, "ord", "t", SCORES, part="f").collect())
    assert got == [("x", 1, 2), ("y", 1, 3)]
