"""Null ids and ids beyond 2**53 in one batch come out as they went in, whatever else the table holds."""

from collections import Counter

from calembour.operators import packed_values, providers, row_parsing
from calembour.operators.providers import Stub
from calembour.operators.vector_search import top_k
from calembour.plans import pipelines

KEYS = [None if i % 3 == 0 else (1 << 53) + 2 * i + 1 for i in range(96)]


def counted(df, key):
    return Counter(r[key] for r in df.select(key).collect())


def test_packed_values(spark):
    df = spark.createDataFrame([(k, "a, b", None, "x", 1) for k in KEYS], "rec_id bigint, first string, second string, value string, pos int")
    out = packed_values.unpack_values(df, "rec_id", ["first", "second"])
    assert dict(out.dtypes)["rec_id"] == "bigint" and counted(out, "rec_id") == Counter(k for k in KEYS for _ in "ab")


def test_raw_lines(spark):
    df = spark.createDataFrame([(k, '"', "clash", "clash") for k in KEYS], "line_id bigint, line string, reason string, chunk string")
    assert counted(row_parsing.bad_records(df), "line_id") == Counter(KEYS)


def test_loops(spark):
    df = spark.createDataFrame([(k, "s", "t", 1) for k in KEYS], "k bigint, s string, t string, iteration int")
    assert counted(providers.loop(df, "k", "t", lambda t, i: (t, True), 3), "k") == Counter(KEYS)
    trace = pipelines.refine(df, Stub(lambda p: "Rating: 4"), "k", "s", "t")
    assert counted(trace, "k") == Counter({k: 4 * n for k, n in Counter(KEYS).items()})


def test_vectors(spark):
    df = spark.createDataFrame([(k, [1.0, float(i)]) for i, k in enumerate(KEYS)], "vec_id bigint, embedding array<float>")
    found = top_k(df, df.where(f"vec_id = {KEYS[1]}"), k=2).collect()
    assert {r["query"] for r in found} == {KEYS[1]} and {r["neighbour"] for r in found} <= set(KEYS) - {None}
