import random

import pytest
from pyspark.sql import functions as F

from calembour.llm import mixing
from calembour.llm.mixing import mix


def tables(spark):
    text = "One two three four five six seven eight nine ten."
    docs = [(i, text, "big") for i in range(400)] + [(1000 + i, text, "Small Ones" if i % 2 else "small_ones") for i in range(20)] + [(2000 + i, text, "mid") for i in range(60)]
    docs += [(3000, None, "big"), (3001, "", "mid"), (3002, text, None), (3003, text, "unlisted")]
    targets = [("big", 0.5, 1), ("small_ones", 0.2, 3), ("mid", 0.2, 4), ("nobody", 0.1, 2)]
    return spark.createDataFrame(docs, "doc_id bigint, text string, source string").withColumn("k", F.lit("clash")), spark.createDataFrame(targets, "source string, target_share double, max_repeats int")


def test_shares_epochs_and_caps(spark):
    docs, targets = tables(spark)
    chosen, report = mix(docs, targets)
    rows = {r["source"]: r for r in report.collect()}
    total = sum(r["available_tokens"] for r in rows.values())
    per_doc = rows["big"]["available_tokens"] // 400
    for name in ("big", "mid"):
        assert abs(rows[name]["mixed_tokens"] - rows[name]["target_share"] * total) <= per_doc / 2 + 1e-6 and not rows[name]["capped"]
    assert rows["small_ones"]["capped"] and rows["small_ones"]["mixed_tokens"] == 3 * rows["small_ones"]["available_tokens"]
    assert rows["nobody"]["mixed_tokens"] == 0 == rows["nobody"]["n_documents"]
    assert sum(r["actual_share"] for r in rows.values()) == pytest.approx(1, abs=1e-5)
    copies = {}
    for r in chosen.collect():
        copies.setdefault(r["source"], []).append(r["copies"])
        assert r["doc_id"] < 3000
    # whole epochs first: within a source the copies differ by one at most
    for name, cs in copies.items():
        n = rows[name]["n_documents"]
        assert max(cs) <= {"big": 1, "small_ones": 3, "mid": 4}[name]
        assert (min(cs) if len(cs) == n else 0) >= max(cs) - 1


def test_same_seed_same_mix_and_a_smaller_total(spark):
    docs, targets = tables(spark)
    a = sorted(map(tuple, mix(docs, targets, total=500)[0].collect()))
    b = sorted(map(tuple, mix(docs.repartition(7), targets, total=500)[0].collect()))
    c = sorted(map(tuple, mix(docs, targets, total=500, seed=3)[0].collect()))
    assert a == b != c


def test_better_documents_are_drawn_more_often(spark):
    good = "This is a whole sentence of some words. And here is another one of them."
    docs = spark.createDataFrame([(i, good if i % 2 else "x ]] [[ q ;; w " * 4, "s") for i in range(600)], "doc_id bigint, text string, source string")
    chosen, _ = mix(docs, spark.createDataFrame([("s", 0.3, 1)], "source string, target_share double, max_repeats int"))
    odd = chosen.where("doc_id % 2 = 1").count()
    assert odd > 1.5 * (chosen.count() - odd)


def test_empty(spark):
    docs, targets = tables(spark)
    chosen, report = mix(docs.limit(0), targets)
    assert chosen.count() == 0 and report.count() == 4
    assert mix(docs, targets.limit(0))[0].count() == 0


@pytest.mark.parametrize("border", [3, 100_000])
def test_the_border_is_cut_until_it_is_small(spark, border):
    rng = random.Random(2)
    rows = [(i, f"s{i % 3}", rng.randint(1, 9), rng.random() if i % 3 else 0.5) for i in range(3000)]  # the keys of s0 are all the same
    docs = spark.createDataFrame(rows, "id bigint, source string, tokens bigint, k double")
    rests = {"s0": 700.0, "s1": 1234.5, "s2": 0.0}
    sources = spark.createDataFrame([(s, 1, r) for s, r in rests.items()], "source string, epochs int, rest double")
    got = {r["id"] for r in mixing.drawn(docs, sources, border).where("drawn = 1").collect()}
    want = set()
    for s, rest in rests.items():
        total = 0
        for _, i, tokens in sorted((k, i, t) for i, source, t, k in rows if source == s):
            total += tokens
            if total - tokens / 2 <= rest:
                want.add(i)
    assert got == want and got
