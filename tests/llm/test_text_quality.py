import pytest

from calembour.llm.text_quality import kind_of, not_prose, quality, statistics

COMMON = frozenset("the a of le la".split())
PROSE = "The score went up after we had removed the lines. That is why we kept both versions, and let the readers choose."
WRAPPED = "The score went up after we had removed the duplicate lines. That is why\nwe kept both versions and let the readers choose between them all. You\ncan't explain a joke and keep it."


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, None), ("", None), (" \n\t", None),
        (PROSE, "prose"), (WRAPPED, "prose"), ("# Title\n\n" + PROSE, "prose"), ("- What is it, then?\n- I would not know that.\n— It is the word, of course.", "prose"), (PROSE + " 🙃🙃", "prose"),
        ("Warum lacht der Bäcker im Keller? Weil der Witz zu tief war.", "prose"),
        ("- ruler\n- measuring stick\n- baker", "list"), ("1. a\n2. b\n3. c", "list"), ("[x] ruler\n[ ] bank", "list"), ("Glossary\nnote: pitch\nspring\nbark", "list"),
        ("ruler · bank · cold tea · spoon · fork", "list"), ("Words to check:\nruler, bank, cold tea, spoon, fork", "list"), ("Entries kept for the next round.\na | b | c | d | e and f | g", "list"),
        ("| a | b | c |\n| 1 | 2 | 3 |\n| 4 | 5 | 6 |", "table"), ("a;b;c\n1;2;3\n4;5;6", "table"), ("a\tb\tc\n1\t\t3", "table"), ('"a","b","c"\n"1","2","3"', "table"), ("id      word     n\n1       bank     2\n2       fan      3", "table"), ("+---+---+---+\n|a  |b  |c  |\n+---+---+---+\n|1  |2  |3  |", "table"),
        ("?" * 80, "junk"), ("a" * 300, "junk"), ("crane " * 40, "junk"), ("note\n" * 30, "junk"), ("#~(&;@;/;=|-(-!-*_:>!%$)?|^(;$:/?#", "junk"), ("a0bceb45 871622fe 56922f99 921394 f8fec004", "junk"),
        ('<li class="a"><a href="#0"></a></li><td class="b"><a href="#1"></a></td>', "junk"), ("Home Login Print « Prev Next » Menu Share Home Reply Like Top >>> ©", "junk"), ("ladder son herb breeze bookmark word plant hours parasol flash pitch souffle chapel raincoat teapot kettle", "junk"),
        ("Ã©tait lÃ� ¤avec� Ã¨s du¬ dÃ©p©t et� Ã©crit.", "junk"),
    ],
)
def test_kinds(text, want):
    assert kind_of(text, statistics(text, COMMON)) == want
    if text:
        assert kind_of(text.replace("\n", "\r\n"), statistics(text.replace("\n", "\r\n"), COMMON)) == want


def test_statistics():
    s = statistics("The cat sat. The cat sat.\nA dog!\nA dog!", COMMON)
    assert (s["n_words"], s["punctuated_lines"], s["duplicate_lines"]) == (10, 1.0, pytest.approx(1 / 3))
    assert s["mean_word_length"] == pytest.approx(26 / 10) and s["common_words"] == pytest.approx(4 / 10) and s["symbol_ratio"] == pytest.approx(4 / 30)
    assert set(statistics(None, COMMON).values()) == {0}


def test_tables(spark):
    df = spark.createDataFrame([(1, PROSE), (2, None), (3, "- ruler\n- bank"), (3, "- ruler\n- bank"), (4, "x" * 2_000_000)], "doc_id bigint, text string").selectExpr("doc_id", "text", "'c' AS kind", "'d' AS k")
    cw = spark.createDataFrame([("the",), (None,)], "word string")
    assert sorted(tuple(r) for r in not_prose(df, cw).collect()) == [(3, "list"), (3, "list"), (4, "junk")]
    assert quality(df, cw).count() == 5 and quality(df.limit(0), cw).count() == 0


def test_hand_labels(spark):
    """Held-out accuracy on the labelled documents; a few labels are wrong."""
    sf = "/root/testdata/sf0.1"
    df = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/doc_labels.parquet").groupBy("doc_id").agg({"kind": "min"}).withColumnRenamed("min(kind)", "label"), "doc_id")
    rows = quality(df, spark.read.parquet(f"{sf}/common_words.parquet")).join(df.select("doc_id", "label"), "doc_id").where("kind IS NOT NULL").collect()
    assert sum(r["kind"] == r["label"] for r in rows) >= 0.95 * len(rows)
