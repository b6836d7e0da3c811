import json
import random

import pytest
from pyspark.sql import functions as F

from calembour.llm import dressed_duplicates as D

NAMES = ["en", "text_clean", "pun_type"]


def pairs(df):
    return sorted(map(tuple, df.select("keep_id", "dup_id").collect()))


def test_dress_does_not_matter(spark):
    rows = [(1, "It's a pun!"), (2, "  it s A\tPUN "), (3, "its a pün"), (4, None), (5, "?!"), (6, ""), (7, "its a pün"), (8, "ITS A PÜN..."), (9, "its a pun 2")]
    df = spark.createDataFrame(rows, "ord bigint, en string").withColumn("id", F.lit("clash")).withColumn("f1", F.lit(0))
    assert pairs(D.table_copies(df, "ord", "en")) == [(1, 2), (3, 7), (3, 8)]


def test_field_order_and_form_do_not_matter(spark):
    a = json.dumps({"en": "A b", "text_clean": "c", "pun_type": "d"})
    b = '{"PUN_TYPE":"D.",\n "Text_Clean": "C",\t"EN":"a\\tB"}'
    c = "text_clean = C\tEN=a-b\tpun_type= d"
    other = json.dumps({"en": "c", "text_clean": "A b", "pun_type": "d"})
    rows = [(5, a), (2, b), (9, c), (4, other), (7, None), (8, "nonsense"), (10, "nonsense"), (11, '{"en": null, "text_clean": "x"}'), (12, '{"en": null, "text_clean": "x"}')]
    df = spark.createDataFrame(rows, "dump_id bigint, record string")
    assert pairs(D.record_copies(df, "dump_id", "record", NAMES, "en")) == [(2, 5), (2, 9)]


def test_empty_tables_and_copy_counts(spark):
    df = spark.createDataFrame([(1, "a"), (2, "A"), (3, None), (4, "b")], "ord bigint, en string")
    assert D.table_copies(df.limit(0), "ord", "en").count() == 0
    found = D.table_copies(df, "ord", "en")
    assert sorted(map(tuple, D.collapsed(found, df, "ord").collect())) == [(1, 2), (3, 1), (4, 1)]


def test_colliding_fingerprints_are_told_apart(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "A"), (4, "B"), (5, "c")], "ord bigint, en string")
    prints = D.fingerprints(df, "ord", D.pairs_of_columns(["en"]), ["en"], "en").withColumns({"f1": F.lit(1).cast("bigint"), "f2": F.lit(1).cast("bigint")})
    assert pairs(D.copies(prints, 5)) == [(1, 3), (2, 4)]


@pytest.mark.parametrize("hot", [1, 30])
def test_brute_force_with_a_hot_group(spark, monkeypatch, hot):
    import calembour.operators.skew as skew

    monkeypatch.setattr(skew, "HOT_LEAST", hot)
    rng = random.Random(5)
    rows = [(i, "the same" if i % 3 == 0 else "".join(rng.choice("ab .É") for _ in range(4))) for i in range(300)]
    groups = {}
    for i, t in rows:
        key = "".join(c for c in t.lower() if c.isalnum())
        if key:
            groups.setdefault(key, []).append(i)
    want = sorted((g[0], x) for g in groups.values() for x in g[1:])
    assert pairs(D.table_copies(spark.createDataFrame(rows, "ord bigint, en string"), "ord", "en")) == want


def test_a_long_text(spark):
    df = spark.createDataFrame([(1, "word, " * 100_000), (2, "WORD " * 100_000)], "ord bigint, en string")
    assert pairs(D.table_copies(df, "ord", "en")) == [(1, 2)]
