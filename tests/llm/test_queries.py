import pytest

from calembour.llm import queries as Q
from tests.oracle import connect, rows_of, rows_of_sql

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert rows_of(Q.queries()[name](spark, SF)) == rows_of_sql(connect(SF), Q.oracle_sql()[name])


@pytest.mark.parametrize(("name", "columns"), [("p2_found", "pair_id field_name defect"), ("p4_found", "field_name a_ord b_ord"), ("p5_found", "fr_ord id"), ("p7_ids", "doc_id ids"), ("p9_found", "doc_id kind")])
def test_columns(spark, name, columns):
    df = Q.queries()[name](spark, SF)
    assert df.columns == columns.split() and df.count() > 0


def test_counts_of_both_tables(spark):
    rows = Q.p1_copies(spark, SF).collect()
    found = Q.p1_found(spark, SF).collect()
    for tab, key in (("translation_en", "ord"), ("joke_dump", "dump_id")):
        own = {r["keep_id"]: r["copies"] for r in rows if r["tab"] == tab}
        ids = {r[key] for r in spark.read.parquet(f"{SF}/{tab}.parquet").select(key).collect()}
        want = dict.fromkeys(ids - {r["dup_id"] for r in found if r["tab"] == tab}, 1)
        for r in found:
            if r["tab"] == tab:
                want[r["keep_id"]] += 1
        assert own == want and sum(own.values()) == len(ids) and max(own.values()) > 1


def test_one_form_of_both_tables_agrees_with_the_pairs(spark):
    form = {(r["field_name"], r["ord"]): r["canonical"] for r in Q.p4_one_form(spark, SF).collect()}
    for field, tab in (("text_clean", "cleaned_en"), ("text_fr", "translation_fr")):
        assert {o for f, o in form if f == field} == {r["ord"] for r in spark.read.parquet(f"{SF}/{tab}.parquet").select("ord").collect()}
    pairs = Q.p4_found(spark, SF).collect()
    assert pairs and all(form[r["field_name"], r["a_ord"]] == form[r["field_name"], r["b_ord"]] for r in pairs)
