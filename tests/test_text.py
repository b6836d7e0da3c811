import re

import pytest
from pyspark.sql import functions as F

from calembour.functions import text as T


def one(spark, column, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r["y"] for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_cleaning_steps(spark):
    assert one(spark, lambda c: T.replaced(c, T.LITERALS), "a\\nb", "a\nb", "3. x", "''q''") == ["a b", "a\nb", "3.x", '"q"']
    assert one(spark, T.clean_text, "- a - b", "x#dadjokes", None) == ["a-b", "xs", None]
    assert one(spark, T.lower_shouted_openings, "OLD SOLDIERS never DIE", 'OLD IT GUYS "ACE," fade AWAY', "OLD 123 CATS", "x  y\nz", "OLD", "") == [
        "Old soldiers never DIE", 'Old IT guys "ace," fade AWAY', "Old 123 CATS", "x y z", "Old", "",
    ]
    assert one(spark, T.plain_speech_tags, "spouted said Tom", "said Tom") == ["spouted Tom said", "Tom said"]
    assert one(spark, T.quoted_speech, "I know, Tom said") == ['"I know," Tom said']
    assert one(spark, T.pronouns, "Tom's x Tom", "Tomorrow") == ["his x he", "heorrow"]
    assert one(spark, T.dashes_to_sentences, 'hi -- éa there -- xyz -- "q"') == ['hi. Éa there. Xyz -- "q"']


def shouted(sentence):
    """The rule for shouted openings, row by row, for comparison."""
    ws = sentence.split()
    if not ws or ws[0] != "OLD":
        return " ".join(ws)
    out, running = ["Old"], True
    for w in ws[1:]:
        if len(w) > 2:
            running = running and w.isupper()
            w = w.lower() if running else w
        out.append(w)
    return " ".join(out)


def test_shouted_openings_row_by_row(spark, sf):
    df = spark.read.parquet(f"{sf}/translation_en.parquet").where("en IS NOT NULL").select("en", T.lower_shouted_openings(F.col("en")).alias("y"))
    rows = df.collect()
    assert rows and all(r["y"] == shouted(r["en"]) for r in rows)


def test_json(spark):
    assert one(spark, T.json_slice, 'x {"a":1} y', "none", "}{", None) == ['{"a":1}', None, None, None]
    assert one(spark, T.strict_json, '{"a":1}', '{"a":1} post {z}', "{'a':1}", None) == ['{"a":1}', None, None, None]


def test_lists_and_ratings(spark):
    assert one(spark, T.list_literal, "[\"l'eau\", 'x']", "['it\\'s \"q\"']", "[]", "x", None) == [["l'eau", "x"], ['it\'s "q"'], [], None, None]
    assert one(spark, T.rating, "Rating: 2/2", "Rating:x", "Rating:\n 3 Rating: 1", None) == [2, None, 3, None]
    assert one(spark, T.justification, "Rating: 1\nJustification:  a\nb ", "x") == ["a\nb", "No justification"]


def test_tokens(spark):
    assert one(spark, T.tokens, "It's A-b é") == [["it's", "a", "b"]]
    assert one(spark, T.content_tokens, "The bank and the bank") == [["bank", "bank"]]
    assert one(spark, T.bare_word, "l'été!", "a_b?") == ["l'été", "a_b"]
    assert one(spark, T.concept_term, "/c/fr/Deux_mots", "/c/en/x") == ["deux mots", None]
    assert one(spark, T.simple_lemma, "Été", "two words", "ab") == ["été", None, None]


@pytest.mark.parametrize("task", sorted(T.TEMPLATES))
def test_templates_have_places(task):
    assert re.search("%s", T.TEMPLATES[task])
