import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from calembour.functions import sequences as S
from calembour.operators import phonetic
from calembour.plans.lexicon_queries import SOUNDS, _bigrams, bigram_similarity

WORDS = ["poireau", "poire", "farine", "marine", "vitre", "titre", "grue", "rue", "", "x", "éÉ", "Sole", "sol", "boulon", "boulot"]


def test_alignment_equals_the_column_expression(spark):
    model = phonetic.SoundModel(SOUNDS, WORDS)
    pairs = [(a, b) for a in WORDS for b in WORDS]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", _bigrams(F.col("a")).alias("ga"), _bigrams(F.col("b")).alias("gb"))
    want = {(r["a"], r["b"]): r["s"] for r in df.select("a", "b", S.alignment_score(F.col("ga"), F.col("gb"), bigram_similarity).alias("s")).collect()}
    for a in WORDS:
        for b, got in zip(WORDS, model.alignment(model.grams(a)), strict=True):
            assert got == pytest.approx(want[a, b], abs=1e-9), (a, b)


def test_vectors_come_near_the_alignment_of_words_not_seen():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
    model = phonetic.SoundModel(SOUNDS, sorted({word() for _ in range(300)}))
    fresh = [word() for _ in range(60)]
    exact = phonetic.SoundModel(SOUNDS, fresh)
    want = np.array([exact.alignment(exact.grams(w)) for w in fresh])
    vectors = np.array([model.embed(w) for w in fresh])
    error = np.mean((vectors @ vectors.T - want) ** 2)
    assert error < 0.003 and error < 0.1 * want.var()


def test_table(spark):
    df = spark.createDataFrame([(w, "x") for w in [*WORDS, None, "poire"]], "word string, embedding string")
    model = phonetic.fit(df, SOUNDS, landmarks=8, dims=5)
    assert len(model.args[1]) == 8 and model.args[1] == phonetic.fit(df.repartition(3), SOUNDS, landmarks=8).args[1]
    got = phonetic.embedded(df, model, to="v").collect()
    assert len(got) == len(WORDS) + 2
    assert all((r["v"] is None) == (r["word"] is None) and (r["v"] is None or len(r["v"]) <= 5) for r in got)
    assert len({tuple(r["v"]) for r in got if r["word"] == "poire"}) == 1
    assert phonetic.embedded(df.limit(0), model).count() == 0
    with pytest.raises(ValueError, match="no words"):
        phonetic.fit(df.limit(0), SOUNDS)
