import csv
import io

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from calembour.functions.automata import CHUNK, Automaton, lay_out
from calembour.operators.row_parsing import LIST, LIST_END, RECORD, bad_records, good_records, list_items, lists_ok, parse_batch, parse_records

GOOD = "en_1,bank,homographic,\"['a', 'b']\",\"[\"\"c\"\"]\",[],12"


def reason(line):
    return parse_batch([line])["reason"][0]


@pytest.mark.parametrize(
    ("line", "want"),
    [
        (GOOD, None),
        ('"en_1","bank"," HOMOPHONIC ","[]","[]","[]","12"', None),
        (None, "column_count"),
        ("", "column_count"),
        (",,,", "column_count"),
        ("en_1\tbank", "column_count"),
        (GOOD + ",x", "column_count"),
        ('en_1,ba"nk,homographic,[],[],[],1', "quoting"),
        ('en_1,"bank"x,homographic,[],[],[],1', "quoting"),
        ('en_1, "bank",homographic,[],[],[],1', "quoting"),
        ('en_1,"bank,homographic,[],[],[],1', "quoting"),
        ('"', "quoting"),
        ("en1,bank,homographic,[],[],[],1", "value"),
        ("en_1, ,homographic,[],[],[],1", "value"),
        ("en_1,bank,both,[],[],[],1", "value"),
        ("en_1,bank,homographic,['a',],[],[],1".replace("['a',]", "\"['a',]\""), "value"),
        ("en_1,bank,homographic,[],[],\"['a' 'b']\",1", "value"),
        ("en_1,bank,homographic,[],[],[],1 ", "value"),
        ("en_1,bank,homographic,\" [ 'a' ,\n \"\"b\"\" ] \",[],[],1", None),
    ],
)
def test_reasons(line, want):
    assert reason(line) == want


def test_offsets():
    out = parse_batch(['en_1,ba"nk,x', 'a,"open', "en_1,bank,homographic,x,[],[],1"])
    assert out["error_offset"].tolist() == [7, 2, 22]


def test_typed_values():
    row = parse_batch(["en_7,\"a \"\"b\"\"\",HOMOPHONIC ,\"['x\\'y', \"\"z\"\"]\",[],\"['p\\\\q']\",007"]).iloc[0]
    assert (row["id_en"], row["pun_word"], row["pun_type"], row["first_meaning"], row["second_meaning"], row["first_context"], row["chunk"]) == (
        "en_7", 'a "b"', "homophonic", ["x'y", "z"], [], ["p\\q"], 7,
    )


def test_digits_beyond_a_bigint_are_valid():
    row = parse_batch(["en_1,w,homophonic,[],[],[]," + "9" * 40]).iloc[0]
    assert row["reason"] is None and row["chunk"] is None


@given(st.lists(st.lists(st.text(alphabet='ab ,"\n', max_size=6), min_size=1, max_size=9), min_size=1, max_size=5))
@settings(max_examples=200, deadline=None)
def test_well_formed_rows_split_as_the_csv_module_does(rows):
    lines = []
    for r in rows:
        out = io.StringIO()
        csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="").writerow(r)
        lines.append(out.getvalue())
    from calembour.operators.row_parsing import tokenize

    fields, bad, _ = tokenize(lines)
    assert fields == rows and (bad < 0).all()


def step_by_step(machine: Automaton, text: str) -> list[int]:
    codes, _, ends = lay_out([text])
    cls = machine.classify(codes)
    cls[ends] = 1
    now, out = machine.start, []
    for c in cls:
        out.append(int(now))
        now = machine.table[c][now]
    return out


@given(st.text(alphabet="ab[]'\",\\ \n", max_size=60), st.integers(1, 40))
@settings(max_examples=150, deadline=None)
def test_composed_chunks_equal_one_walk(text, times):
    long = (text * times)[: CHUNK * 5]
    for machine in (RECORD, LIST):
        codes, _, ends = lay_out([long])
        cls = machine.classify(codes)
        cls[ends] = 1
        assert machine.run(cls).tolist() == step_by_step(machine, long)


def test_a_quoted_field_of_a_million_characters():
    out = parse_batch([f"en_1,w,homophonic,\"['{'x, ' * 250_000}']\",[],[],1"])
    assert out["reason"][0] is None and len(out["first_meaning"][0][0]) == 750_000


def test_lists():
    assert lists_ok(["[]", " [ ] ", "['a']", '["a", \'b\']', "['a',]", "[a]", "[['a']]", "['a", ""]).tolist() == [True, True, True, True, False, False, False, False, False]
    assert list_items("['it\\'s', \"b\\nc\"]") == ["it's", "b\nc"]
    assert LIST_END == 8


def test_table(spark):
    df = spark.createDataFrame([(1, "f", GOOD), (2, "f", None), (1, "f", GOOD)], "line_id bigint, file_name string, line string")
    df = df.withColumnRenamed("file_name", "reason")  # a clashing extra column
    assert good_records(df).count() == 2
    assert [tuple(r) for r in bad_records(df).collect()] == [(2, "column_count", 0)]
    assert parse_records(df.limit(0)).count() == 0
