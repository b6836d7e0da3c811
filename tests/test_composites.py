import pytest
from pyspark.sql import functions as F

from calembour.functions import vectors as V
from calembour.operators import panel, relational, vector_search
from calembour.operators.providers import Stub
from calembour.plans import pipelines


def test_slices_and_pairs(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "k bigint, position_text string").repartition(4)
    got = {(r["k"], r["position"]) for r in relational.sliced(df, ["k"], [(0, 3), (4, 6), (60, 70)]).collect()}
    assert got == {(i, i) for i in (0, 1, 2, 4, 5)}
    assert relational.sliced(df, ["k"], []).count() == 0
    other = spark.createDataFrame([(i,) for i in range(20)], "r bigint")
    pairs = relational.random_pairs(df.select("k"), other, "k", "r").collect()
    assert len(pairs) == 20 == len({p["k"] for p in pairs}) == len({p["r"] for p in pairs})
    assert relational.random_pairs(df.select("k").limit(0), other, "k", "r").count() == 0


def test_mean_of_vectors(spark):
    df = spark.createDataFrame([(1, [[1.0, 2.0], [3.0, 6.0]]), (2, [[1.0, 1.0]]), (3, []), (4, None)], "k int, v array<array<float>>")
    got = {r["k"]: r["m"] for r in df.select("k", V.mean(F.col("v")).alias("m")).collect()}
    assert got == {1: [2.0, 4.0], 2: [1.0, 1.0], 3: None, 4: None}


def test_similarity_of_unknown_and_missing_words(spark):
    df = spark.createDataFrame([(1, "a", "b", ["a", "b"], ["z"], None, ["b"]), (2, None, None, None, None, [], [])], "rec_id bigint, pun_word string, pun_word_fr string, first_meaning array<string>, second_meaning array<string>, first_meaning_fr array<string>, second_meaning_fr array<string>")
    vectors = spark.createDataFrame([("a", [1.0, 0.0], "extra"), ("b", [0.0, 1.0], "extra")], "word string, embedding array<float>, rec_id string")
    rows = {r["rec_id"]: r for r in pipelines.similarity(df, vectors).collect()}
    assert rows[1]["first_similarity_en"] == pytest.approx(0.5**0.5) and rows[1]["second_similarity_fr"] == pytest.approx(1)
    assert rows[1]["second_similarity_en"] is None and rows[1]["first_similarity_fr"] is None and rows[1]["first_difference"] is None
    assert rows[2]["first_similarity_en"] is None and len(rows) == 2


def test_refinement_stops_when_accepted_and_keeps_the_last_text_unscored(spark):
    def rule(prompt):
        if prompt.startswith("Improve"):
            assert "KEY FEEDBACK:\nequivalence: short" in prompt
            return prompt.partition("\nCurrent: ")[2].partition("\n")[0] + "x"
        long = prompt.rpartition("\nPun: ")[2].partition("\n")[0].count("x")
        return f"Rating: {min(4, long)}\nJustification: short" if "of this French pun" in prompt else ""

    df = spark.createDataFrame([(1, "s", ""), (2, "s", "xxx"), (3, None, "x"), (4, "s", None)], "k bigint, s string, t string")
    trace = pipelines.refine(df, Stub(rule), "k", "s", "t")
    rounds = {r["k"]: r["n"] for r in trace.groupBy("k").agg(F.max("iteration").alias("n")).collect()}
    assert rounds == {1: 4, 2: 1, 3: 3}
    assert trace.groupBy("k", "iteration").count().where("count <> 4").isEmpty()
    best = {r["k"]: (r["iteration"], r["accepted"]) for r in panel.best_iteration(trace, "k").collect()}
    assert best == {1: (4, True), 2: (1, True), 3: (3, True)}
    never = pipelines.refine(df.where("k = 1"), Stub(lambda p: "nothing"), "k", "s", "t")
    assert never.agg(F.max("iteration")).first()[0] == 5 and not panel.best_iteration(never, "k").first()["accepted"]
    assert pipelines.refine(df.limit(0), Stub(rule), "k", "s", "t").count() == 0


def test_back_translation(spark):
    df = spark.createDataFrame([("mot", ["a"], ["b"], None, None)], "pun_word_fr string, first_meaning_fr array<string>, second_meaning_fr array<string>, first_context_fr array<string>, second_context_fr array<string>")
    got = pipelines.back_translate(df, Stub(lambda p: p[p.index("{") :].replace('"mot"', '"word"'))).first()
    assert (got["pun_word_back"], got["first_meaning_back"], got["error"]) == ("word", ["a"], None)


def test_whole_translation(spark):
    make = spark.createDataFrame
    sentences = make([(1, "the sole thing"), (2, "nothing here"), (3, None)], "k bigint, text string")
    vocabulary = make([("sole",), ("thing",), ("nothing",), ("here",)], "word string")
    senses = make([("sole", 1, "sole.1", "fish"), ("sole", 2, "sole.2", "only")], "word string, ord bigint, sense string, label string")
    far = make([("sole.1", "sole.2", 5), ("sole.2", "sole.1", 5)], "s1 string, s2 string, d int")
    dictionary = make([("fish", "sole", 1), ("only", "sole", 2), ("thing", "chose", 3)], "en string, fr string, ord bigint")
    words = make([("sole", "sl", 1)], "word string, phon string, ord bigint")
    related = make([("sole", "mer", 5.0, 1)], "word string, term string, weight double, ord bigint")
    rows = {r["k"]: r for r in pipelines.translate_puns(sentences, "k", "text", vocabulary, senses, far, dictionary, words, related, make([], "word string, synonym string")).collect()}
    assert (rows[1]["kind"], rows[1]["level"], rows[1]["pun"], rows[1]["sentence"]) == ("ambiguous", 4, "sole", "the sole chose")
    assert rows[2]["kind"] is None and rows[2]["sentence"] == "nothing here" and rows[3]["sentence"] is None


def test_index_of_unit_vectors(spark, tmp_path):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [30.0, 41.0])], "vec_id bigint, embedding array<float>")
    vector_search.save_index(df, str(tmp_path / "i"))
    e = vector_search.load_index(spark, str(tmp_path / "i"))
    first = vector_search.top_k(e, e.where("vec_id = 1"), k=1, unit=False).first()
    assert first["neighbour"] == 3 and first["score"] == pytest.approx(1, abs=1e-3)
