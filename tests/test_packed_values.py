import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from calembour.operators.packed_values import Dictionary, known_values, split_values, unpack_values

NONE = Dictionary([])


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, []),
        ("", []),
        (" \t\n", []),
        ("[]", []),
        (" ; , | ", []),
        ("one", ["one"]),
        ("a, b;c | d / e", ["a", "b", "c", "d", "e"]),
        ("a · b • c、d", ["a", "b", "c", "d"]),
        ("- a\n- b", ["a", "b"]),
        ("1. a\n2. b", ["a", "b"]),
        ("1) a 2) b", ["a", "b"]),
        ("(1) a; (2) b", ["a", "b"]),
        ("a;;b; ", ["a", "b"]),
        ('"a, b"; c', ["a, b", "c"]),
        ('"a ""b"""', ['a "b"']),
        ("“a; b” “c”", ["a; b", "c"]),
        ("« l'eau » « feu »", ["l'eau", "feu"]),
        ("['a', \"b's\"]", ["a", "b's"]),
        ('["a \\"b\\"", "\\u00e9"]', ['a "b"', "é"]),
        ("[a, b c]", ["a", "b c"]),
        ("peau de l'arbre", ["peau de l'arbre"]),
        ("well-known, long-eared", ["well-known", "long-eared"]),
        ("a\tb", ["a", "b"]),
        ('5" pipe', ['5" pipe']),
    ],
)
def test_forms(text, want):
    assert split_values(text, NONE) == want


def test_a_known_value_keeps_its_separator():
    known = Dictionary(["rock, paper", "and/or"])
    assert split_values("x; rock, paper; and/or", known) == ["x", "rock, paper", "and/or"]
    assert split_values("rock, paper, scissors", known) == ["rock, paper", "scissors"]
    assert split_values("a rock, paper b", known) == ["a rock", "paper b"]


@given(st.lists(st.text(alphabet="abc de", min_size=1, max_size=8).map(str.strip).filter(bool), min_size=1, max_size=5), st.sampled_from([", ", ";", " | ", "\n"]))
@settings(max_examples=150, deadline=None)
def test_round_trip(values, sep):
    assert split_values(sep.join(values), NONE) == values
    assert split_values(sep.join(f'"{v}"' for v in values), NONE) == values


def test_long_text():
    assert len(split_values("; ".join(["value"] * 50_000), NONE)) == 50_000


def test_table(spark):
    rows = [(1, '"a, b"; c', None), (2, '"a, b"', "x"), (3, "a, b | d", ""), (3, "a, b | d", "")]
    df = spark.createDataFrame(rows, "rec_id bigint, f string, g string").withColumnRenamed("g", "value")
    assert known_values(df, ["f", "value"]) == ["a, b"]
    got = sorted(tuple(r) for r in unpack_values(df, "rec_id", ["f", "value"]).collect())
    assert got == sorted([(1, "f", 1, "a, b"), (1, "f", 2, "c"), (2, "f", 1, "a, b"), (2, "value", 1, "x"), *[(3, "f", 1, "a, b"), (3, "f", 2, "d")] * 2])
    assert unpack_values(df.limit(0), "rec_id", ["f"]).count() == 0


def test_fewest_unknown_pieces():
    assert split_values("x, y, z", Dictionary(["x, y", "y, z", "x"])) == ["x", "y, z"]
    assert split_values("x, y, z", Dictionary(["x", "y", "z"])) == ["x", "y", "z"]


def test_the_support_of_a_known_value_does_not_grow_with_the_table(spark):
    df = spark.range(41_000).selectExpr("id AS rec_id", "CASE WHEN id < 2 THEN '\"green vegetable, market\"' WHEN id = 2 THEN 'green vegetable, market' ELSE 'x' END AS f")
    got = [r["value"] for r in unpack_values(df, "rec_id", ["f"]).where("rec_id = 2").collect()]
    assert got == ["green vegetable, market"]


@pytest.mark.parametrize("hot", [1, 1000])
def test_a_large_dictionary_is_joined_with_the_same_result(spark, monkeypatch, hot):
    import calembour.operators.packed_values as P
    import calembour.operators.skew as skew

    rng = random.Random(4)
    word = lambda: rng.choice("abcd") + rng.choice(["", " e", " 1) f"])
    values = lambda: rng.choice([", ", ";", " | "]).join(rng.choice(['"%s"', "%s"]) % (word() + rng.choice(["", ", " + word()])) for _ in range(rng.randint(1, 6)))
    rows = [(i, values(), rng.choice([None, "", "a, b, c", "[a, b]"])) for i in range(300)]
    df = spark.createDataFrame(rows, "rec_id bigint, f string, g string")
    want = sorted(tuple(r) for r in unpack_values(df, "rec_id", ["f", "g"]).collect())
    plain = sorted((i, n, p, v) for i, f, g in rows for n, t in (("f", f), ("g", g)) for p, v in enumerate(split_values(t, NONE), 1))
    monkeypatch.setattr(P, "MOST_SENT", 0)
    monkeypatch.setattr(skew, "HOT_LEAST", hot)
    joined = unpack_values(df, "rec_id", ["f", "g"])
    assert sorted(tuple(r) for r in joined.collect()) == want != plain and joined.columns == ["rec_id", "field_name", "pos", "value"]


@pytest.mark.parametrize("shape", ['"a, ', "'a, ", "«a ", "“a, ", "a, ", '"', "1. ", "- a\n", "[", "\\"])
def test_long_texts_that_repeat_themselves(shape):
    split_values(shape * (60_000 // len(shape)), Dictionary(["a, a"]))
