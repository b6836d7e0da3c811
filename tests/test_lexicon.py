import difflib
import random

import pytest

from calembour.operators import lexicon as L


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_homophones_use_the_last_sound_and_stored_order(spark):
    lex = frame(spark, [("ver", "vEr", 1), ("vert", "vEr", 2), ("Verre", "vEr", 3), ("vert", "vErt", 4), ("", "x", 5)], "word string, phon string, ord bigint")
    got = sorted((r["word"], r["homophone"], r["rank"]) for r in L.homophones(lex).collect())
    assert got == [("ver", "verre", 2), ("ver", "vert", 1), ("verre", "ver", 1), ("verre", "vert", 2)]
    many = frame(spark, [(f"w{i}", "p", i) for i in range(50)], "word string, phon string, ord bigint")
    assert L.homophones(many).groupBy("word").count().agg({"count": "max"}).first()[0] == 30


def test_subword(spark):
    known = frame(spark, [("pasta",), ("past",), ("asta",)], "word string")
    assert L.longest_subword(frame(spark, [("impasta",), ("xyz",)], "word string"), known).first()["sub"] == "pasta"


def test_subword_of_a_long_run_of_letters(spark):
    known = frame(spark, [("pasta",), ("past",)], "word string")
    words = frame(spark, [("x" * 300 + "pasta" + "y" * 300,), ("pas",)], "word string")
    assert [r["sub"] for r in L.longest_subword(words, known).collect()] == ["pasta"]
    assert L.longest_subword(words, known.limit(0)).count() == 0


def test_closest_word(spark):
    known = ["impaste", "impasto", "pasta", "imposts"]
    got = L.closest_words(frame(spark, [("impasta",)], "word string"), frame(spark, [(k,) for k in known], "word string")).first()["close"]
    assert got == "impasto" == difflib.get_close_matches("impasta", known, 1, 0.78)[0]


def test_closest_words_against_every_pair(spark):
    rng = random.Random(9)
    known = sorted({"".join(rng.choice("abcde") for _ in range(rng.randint(1, 9))) for _ in range(250)})
    asked = sorted({"".join(rng.choice("abcde") for _ in range(rng.randint(1, 9))) for _ in range(80)} - set(known))
    got = {r["word"]: r["close"] for r in L.closest_words(frame(spark, [(a,) for a in asked], "word string"), frame(spark, [(k,) for k in known], "word string")).collect()}
    want = {a: m[0] for a in asked if (m := difflib.get_close_matches(a, known, 1, 0.78))}
    assert got == want


def test_closest_words_of_any_length(spark):
    rng = random.Random(4)

    def changed(w):
        letters = list(w)
        for _ in range(rng.randint(1, 5)):
            i = rng.randrange(len(letters))
            letters[i : i + 1] = rng.choice(([], [rng.choice("abc")], [letters[i], rng.choice("abc")]))
            letters = letters or ["a"]
        return "".join(letters)

    known = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(9, 30))) for _ in range(60)} | {"ab" * 130, "a" * 14})
    asked = sorted({changed(k) for k in known for _ in range(5)} - set(known))
    got = {r["word"]: r["close"] for r in L.closest_words(frame(spark, [(a,) for a in asked], "word string"), frame(spark, [(k,) for k in known], "word string")).collect()}
    want = {a: m[0] for a in asked if (m := difflib.get_close_matches(a, known, 1, 0.78))}
    assert len(want) > 100 and got == want


def test_words_of_few_syllables_do_not_all_meet(spark):
    syllables = [c + v for c in "bdfgklmnprtv" for v in "aeiou"]
    rng = random.Random(5)
    asked, known = ([("".join(rng.choice(syllables) for _ in range(4)),) for _ in range(n)] for n in (1500, 600))
    met = L.meeting_words(frame(spark, asked, "word string"), frame(spark, known, "word string"), 0.78)
    assert met.count() < 0.01 * len(asked) * len(known)


def test_unknown_word_score(spark):
    known = frame(spark, [(w,) for w in ("fake", "noodle", "pasta", "impasto")], "word string")
    s = frame(spark, [(1, "A fake noodle is an impasta"), (2, None), (3, "the of")], "k bigint, t string")
    r = L.unknown_word_puns(s, known, "k", "t").collect()
    assert [(x["word"], x["m1"], x["m2"], x["score"]) for x in r] == [("impasta", "impasto", "pasta", pytest.approx(71.6))]


def test_ambiguous_words(spark):
    senses = frame(spark, [("bank", 0, "b1", "shore"), ("bank", 1, "b2", "money house"), ("river", 0, "r", "stream")], "word string, ord int, sense string, label string")
    d = frame(spark, [("b1", "b2", 7)], "s1 string, s2 string, d int")
    s = frame(spark, [(1, "I went to the bank to watch the river bank.")], "k bigint, t string")
    r = L.ambiguous_word_puns(s, senses, d, "k", "t").first()
    assert (r["word"], r["m1"], r["m2"], r["score"]) == ("bank", "shore", "money house", 7 + 15 + 0.5)


def test_polygons(spark):
    dictionary = frame(spark, [("worm", "ver", 0), ("glass", "verre", 0), ("color", "vert", 0), ("sea", "mer", 0), ("water", "eau", 0), ("maggot", "asticot", 1), ("insect", "ver", 0)], "en string, fr string, ord bigint")
    lex = frame(spark, [("ver", "vEr", 1), ("verre", "vEr", 2), ("vert", "vEr", 3), ("mer", "mEr", 4), ("mère", "mEr", 5), ("océan", "o", 6)], "word string, phon string, ord bigint")
    related = frame(spark, [("verre", "cristal", 5.0, 0), ("vert", "vert clair", 9.0, 0), ("océan", "mer", 8.0, 0), ("mère", "maman", 6.0, 0), ("maman", "eau", 9.0, 1)], "word string, term string, weight double, ord int")
    syn = frame(spark, [("maggot", "insect")], "word string, synonym string")
    seeds = frame(spark, [(1, "worm", "worm"), (2, "worm", "glass"), (3, "maggot", "glass"), (4, "océan", "water"), (5, "nothing", "glass")], "id bigint, m1 string, m2 string")
    got = {r["id"]: (r["level"], r["pun"], r["confidence"], r["fallback"]) for r in L.polygons(seeds, dictionary, lex, related, syn).collect()}
    assert got[1] == (4, "ver", 1.0, None)
    assert got[2] == (5, "verre", 1.0, None)
    assert got[3][:2] == (6, "verre")
    assert got[4] == (7, "mère", pytest.approx(0.9 * 0.8), None)
    assert got[5] == (None, None, None, "nothing")


def test_rewriting(spark):
    s = frame(spark, [(1, "The bank, again!", "bank", "banque")], "k bigint, t string, w string, p string")
    d = frame(spark, [("again", "encore", 0)], "en string, fr string, ord bigint")
    from pyspark.sql import functions as F

    assert L.rewritten(s, d, "k", "t", F.col("w"), "p").first()["sentence"] == "the banque encore"


def test_rewriting_keeps_words_of_marks_only_and_every_kind_of_blank(spark):
    from pyspark.sql import functions as F

    s = frame(spark, [(1, "«Été»\u00a0— d'Or?!\u2003x_1\x1c(\u0130)\0", "", "")], "k bigint, t string, w string, p string")
    d = frame(spark, [("été", "summer", 0)], "en string, fr string, ord bigint")
    assert L.rewritten(s, d, "k", "t", F.lit("none"), "p").first()["sentence"] == "summer  d'or x_1 i"


def test_the_cascade_solves_each_pair_of_meanings_once_and_pairs_no_homophones(spark, monkeypatch):
    built = []
    monkeypatch.setattr(L, "checkpointed", lambda df, keep=L.checkpointed: (built.append((done := keep(df)).count()), done)[1])
    dictionary = frame(spark, [("worm", "w0", 0), ("glass", "W59 ", 0)], "en string, fr string, ord bigint")
    lex = frame(spark, [(f"w{i}", "p", 0 if i == 59 else i + 1) for i in range(60)], "word string, phon string, ord bigint")
    related = frame(spark, [("w3", "far", 2.5, 0), ("w4", "close", 40.0, 0), ("weak", "w2", 2.4, 0)], "word string, term string, weight double, ord int")
    seeds = frame(spark, [(i, "Worm", "glass") for i in range(300)] + [(300, "worm", "far"), (301, "worm", "close"), (302, "worm", "weak"), (303, None, None)], "id bigint, m1 string, m2 string")
    got = {r["id"]: (r["level"], r["pun"], r["confidence"], r["fallback"]) for r in L.polygons(seeds, dictionary, lex, related, frame(spark, [], "word string, synonym string")).collect()}
    assert len(got) == 304 and {got[i] for i in range(300)} == {(5, "w59", 1.0, None)}
    assert (got[300], got[301], got[302], got[303]) == ((5, "w3", 0.25, None), (5, "w4", 1.0, None), (None, None, None, "w0"), (None, None, None, None))
    assert max(built) <= 60


def test_short_words_share_a_remainder_just_when_they_can_be_close(spark):
    rng = random.Random(3)
    a, b = (["".join(rng.choice("abé\U0001f600") for _ in range(rng.randint(1, 9))) for _ in range(60)] for _ in range(2))
    (i, x), (j, y) = L.remainders(a, 0.78, True), L.remainders(b, 0.78, False)
    assert len({*zip(i.tolist(), x.tolist())}) == len(i)
    left, right = ([{*k[n == m].tolist()} for m in range(60)] for n, k in ((i, x), (j, y)))

    def common(s, t):
        row = [0] * (len(t) + 1)
        for c in s:
            out = [0]
            for k, d in enumerate(t):
                out.append(row[k] + 1 if c == d else max(row[k + 1], out[-1]))
            row = out
        return row[-1]

    for m, s in enumerate(a):
        for n, t in enumerate(b):
            assert bool(left[m] & right[n]) == (2 * common(s, t) / (len(s) + len(t)) >= 0.78)
