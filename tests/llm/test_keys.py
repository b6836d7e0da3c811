"""Null ids and ids beyond 2**53 in one batch come out as they went in, whatever else the table holds."""

from collections import Counter

from calembour.llm import answer_defects, dressed_duplicates, entity_matching, lookalikes, mixing, text_quality, tokenizing

KEYS = [None if i % 3 == 0 else (1 << 53) + 2 * i + 1 for i in range(96)]
KNOWN = [k for k in KEYS if k is not None]


def counted(df, key):
    assert dict(df.dtypes)[key] == "bigint"
    return Counter(r[key] for r in df.select(key).collect())


def test_answers(spark):
    df = spark.createDataFrame([(k, "q", "", "homographic", None, "x", 1) for k in KEYS], "pair_id bigint, text_clean string, pun_word string, pun_type string, generated_pun string, k string, q int")
    assert counted(answer_defects.defective_answers(df), "pair_id") == Counter(k for k in KEYS for _ in range(2))


def test_documents(spark):
    df = spark.createDataFrame([(k, "- a\n- b\n- c", "s", 1, 2, "x") for k in KEYS], "doc_id bigint, text string, source string, k int, tokens int, kind string")
    words = spark.createDataFrame([("the", "x")], "word string, kind string")
    assert counted(text_quality.quality(df, words), "doc_id") == Counter(KEYS) == counted(tokenizing.encode(df), "doc_id")
    targets = spark.createDataFrame([("s", 1.0, 1, "x")], "source string, target_share double, max_repeats int, tokens string")
    assert counted(mixing.mix(df, targets)[0], "doc_id") == Counter(KEYS)


def test_copies_and_looks(spark):
    df = spark.createDataFrame([(k, "a b" if i % 2 else "a  b", "x", 1) for i, k in enumerate(KEYS)], "ord bigint, en string, id string, n int")
    assert counted(dressed_duplicates.table_copies(df, "ord", "en"), "dup_id") == Counter(sorted(KNOWN)[1:])
    pairs = lookalikes.same_looking_pairs(df, "ord", "en").collect()
    odd = [k for i, k in enumerate(KEYS) if i % 2 and k is not None]
    assert {frozenset((r["a"], r["b"])) for r in pairs} == {frozenset((a, b)) for a in odd for b in KNOWN if b not in odd} and len(pairs) == len(odd) * (len(KNOWN) - len(odd))


def test_entities(spark):
    text = "Sur la place, Dranuvi Kobale demande « farine » et le voisin apporte un objet."
    left = spark.createDataFrame([(k, text, "Dube Ledutru", "2024-03-05", "x") for k in KEYS], "ord bigint, text_fr string, translator string, submitted_at string, words string")
    right = spark.createDataFrame([("L", text, "Dube Ledutru", "2024-03-05", 1), (None, text, None, None, 2)], "id string, text string, contributor string, noted_on string, e int")
    noted = spark.createDataFrame([("L", "farine"), ("M", "farine"), (None, "x"), ("L", None)], "id string, location string")
    rows = entity_matching.match_entities(left, right, noted).collect()
    assert {r["left_key"] for r in rows} in (set(), set(KEYS))  # a table of one text says nothing about chance
