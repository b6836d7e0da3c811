import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from calembour.llm.tokenizing import BYTE_BPE_50K, encode, vocabulary

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def public():
    t = tokenizers.Tokenizer.from_file(BYTE_BPE_50K)
    t.encode_special_tokens = True
    return t


def texts():
    rng = random.Random(2)
    out = ["", " ", "a", "<|endoftext|>x", "it's we'll", "日本語" * 200, "🙃👩‍🍳", "a" * 3000, "\n\n\t x  y \r\n", "ÅéÉ ß ﬁ", "१२३ ④", "​­﻿"]
    out += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéà '") for _ in range(200)) for _ in range(200)]
    out += ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(0xA0, 0x500), rng.randint(0x3040, 0x30FF)])) for _ in range(60)) for _ in range(200)]
    return out


def test_equals_the_public_library(public):
    got = vocabulary(BYTE_BPE_50K).encode_batch(texts())
    assert got == [e.ids for e in public.encode_batch(texts(), add_special_tokens=False)]


def test_documents(spark, sf, public):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    for r in encode(df).join(df.select("doc_id", "text"), "doc_id").collect():
        assert r["ids"] == (public.encode(r["text"], add_special_tokens=False).ids if r["text"] else [])


def test_compatible_is_what_merging_says():
    v = vocabulary(BYTE_BPE_50K)
    rng = np.random.default_rng(1)
    ids = np.array(sorted(v.ids.values()))
    a, b = rng.choice(ids, 3000), rng.choice(ids, 3000)
    raw = {i: t for t, i in v.ids.items()}
    want = [v.merged(raw[x] + raw[y]) == [x, y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    assert v.compatible(a, b).tolist() == want


def test_exact_merging_of_failing_words():
    v = vocabulary(BYTE_BPE_50K)
    words = [w for t in texts() for w in t.split()]
    wrong = [w for w in words if v.propose(w.encode()) != v.merged(w.encode())]
    assert wrong, "speculation fails on some words, so verification has work to do"


def test_defined_cases(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "x"), (3, "x")], "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    assert sorted((r["doc_id"], r["ids"]) for r in encode(df).collect()) == [(1, []), (2, []), (3, [87]), (3, [87])]
    assert encode(df.limit(0)).count() == 0
