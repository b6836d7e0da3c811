"""The queries of this subpackage, over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calembour.llm import answer_defects, dressed_duplicates, entity_matching, lookalikes, mixing, text_quality, tokenizing
from calembour.operators.layout import spread

RECORD_FIELDS = ["en", "text_clean", "pun_type"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    jokes = dressed_duplicates.table_copies(_table(spark, sf_dir, "translation_en"), "ord", "en")
    records = dressed_duplicates.record_copies(_table(spark, sf_dir, "joke_dump"), "dump_id", "record", RECORD_FIELDS, "en")
    return jokes.select(F.lit("translation_en").alias("tab"), "keep_id", "dup_id").unionByName(records.select(F.lit("joke_dump").alias("tab"), "keep_id", "dup_id"))


def p1_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "translation_en")
    return dressed_duplicates.collapsed(dressed_duplicates.table_copies(df, "ord", "en"), df, "ord")


def p1_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ``p1_collapsed`` says of translation_en, for both tables of the problem."""
    jokes, records = _table(spark, sf_dir, "translation_en"), _table(spark, sf_dir, "joke_dump")
    both = (
        ("translation_en", dressed_duplicates.collapsed(dressed_duplicates.table_copies(jokes, "ord", "en"), jokes, "ord")),
        ("joke_dump", dressed_duplicates.collapsed(dressed_duplicates.record_copies(records, "dump_id", "record", RECORD_FIELDS, "en"), records, "dump_id")),
    )
    return reduce(DataFrame.unionByName, [df.select(F.lit(tab).alias("tab"), "keep_id", "copies") for tab, df in both])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer_defects.defective_answers(_table(spark, sf_dir, "generated_puns"))


def _both_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    en = _table(spark, sf_dir, "cleaned_en").select("ord", F.lit("text_clean").alias("field_name"), F.col("text_clean").alias("t"))
    fr = _table(spark, sf_dir, "translation_fr").select("ord", F.lit("text_fr").alias("field_name"), F.col("text_fr").alias("t"))
    return en.unionByName(fr)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = lookalikes.same_looking_pairs(_both_texts(spark, sf_dir), "ord", "t", part="field_name")
    return pairs.select(F.col("part").alias("field_name"), F.col("a").alias("a_ord"), F.col("b").alias("b_ord"))


def p4_one_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of both tables, under the model that ``p4_found`` trains."""
    return lookalikes.one_form(spread(_both_texts(spark, sf_dir)), "t").select("field_name", "ord", "canonical")


def p5_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_matching.match_entities(_table(spark, sf_dir, "translation_fr"), _table(spark, sf_dir, "location_fr_input"), _table(spark, sf_dir, "location_fr_qrels")).select(
        F.col("left_key").alias("fr_ord"), F.col("right_key").alias("id"), "confidence"
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_matches(spark, sf_dir).select("fr_ord", "id")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizing.encode(_table(spark, sf_dir, "documents"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "mix_targets"))[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "mix_targets"))[1]


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_quality.not_prose(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "common_words"))


def p9_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "common_words"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (p1_found, p1_collapsed, p1_copies, p2_found, p4_found, p4_one_form, p5_found, p5_matches, p7_ids, p8_mix, p8_shares, p9_found, p9_statistics)
    }


_NORMAL = "lower(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}\\p{{M}}]', '', 'g'))"

_P1 = f"""
WITH t AS (SELECT ord AS id, {_NORMAL.format(x="en")} AS v FROM translation_en),
obj AS (SELECT dump_id, record, unnest(json_keys(record)) AS k FROM (SELECT * FROM joke_dump WHERE trim(record) LIKE '{{%')),
lines AS (SELECT dump_id, unnest(string_split(record, chr(9))) AS p FROM joke_dump WHERE trim(record) NOT LIKE '{{%'),
pairs AS (
  SELECT dump_id, lower(trim(k)) AS k, json_extract_string(record, '$."' || k || '"') AS v FROM obj
  UNION ALL SELECT dump_id, lower(trim(split_part(p, '=', 1))), substr(p, strpos(p, '=') + 1) FROM lines),
wide AS (
  SELECT dump_id AS id,
    coalesce(max(CASE WHEN k = 'en' THEN {_NORMAL.format(x="v")} END), '') AS a,
    coalesce(max(CASE WHEN k = 'text_clean' THEN {_NORMAL.format(x="v")} END), '') AS b,
    coalesce(max(CASE WHEN k = 'pun_type' THEN {_NORMAL.format(x="v")} END), '') AS c
  FROM pairs GROUP BY dump_id)"""

P1_FOUND = _P1 + """,
te AS (SELECT id, min(id) OVER (PARTITION BY v) AS keep_id FROM t WHERE v <> ''),
jd AS (SELECT id, min(id) OVER (PARTITION BY a, b, c) AS keep_id FROM wide WHERE a <> '')
SELECT 'translation_en' AS tab, keep_id, id AS dup_id FROM te WHERE id <> keep_id
UNION ALL SELECT 'joke_dump', keep_id, id FROM jd WHERE id <> keep_id
"""

P1_COLLAPSED = f"""
WITH t AS (SELECT ord, {_NORMAL.format(x="en")} AS v FROM translation_en)
SELECT min(ord) AS keep_id, count(*) AS copies FROM t WHERE v <> '' GROUP BY v
UNION ALL SELECT ord, 1 FROM t WHERE v IS NULL OR v = ''
"""

P1_COPIES = _P1 + """
SELECT 'translation_en' AS tab, min(id) AS keep_id, count(*) AS copies FROM t WHERE v <> '' GROUP BY v
UNION ALL SELECT 'translation_en', id, 1 FROM t WHERE v IS NULL OR v = ''
UNION ALL SELECT 'joke_dump', min(id), count(*) FROM wide WHERE a <> '' GROUP BY a, b, c
UNION ALL SELECT 'joke_dump', dump_id, 1 FROM joke_dump WHERE dump_id NOT IN (SELECT id FROM wide WHERE a <> '')
"""


_UNSEEN = r"[\x{00AD}\x{034F}\x{061C}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{FE00}-\x{FE0F}\x{FEFF}]"
_BLANK = r"[ \t\r\f\v\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]+"
_WIDE = {chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)}
_JOINED = {"…": "...", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}


def _look(text: str) -> str:
    """SQL of what the eye sees: characters without a look go, wide and look-alike letters become plain ones, accents are composed."""
    quoted = lambda letters: "'" + "".join(letters).replace("'", "''") + "'"
    x = f"regexp_replace({text}, '{_UNSEEN}', '', 'g')"
    for joined, letters in _JOINED.items():
        x = f"replace({x}, '{joined}', '{letters}')"
    for pairs in (_WIDE, lookalikes.LATIN_OF):
        x = f"translate({x}, {quoted(pairs)}, {quoted(pairs.values())})"
    x = f"regexp_replace(regexp_replace({x}, '{_BLANK}', ' ', 'g'), ' ?\\n ?', chr(10), 'g')"
    return f"nfc_normalize(trim({x}, ' ' || chr(10)))"


P4_FOUND = f"""
WITH t AS (
  SELECT 'text_clean' AS field_name, ord, text_clean AS t, {_look("text_clean")} AS look FROM cleaned_en
  UNION ALL SELECT 'text_fr', ord, text_fr, {_look("text_fr")} FROM translation_fr)
SELECT a.field_name, a.ord AS a_ord, b.ord AS b_ord FROM t a JOIN t b ON a.field_name = b.field_name AND a.look = b.look AND a.ord < b.ord AND a.t <> b.t WHERE a.look <> ''
"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_FOUND, "p1_collapsed": P1_COLLAPSED, "p1_copies": P1_COPIES, "p4_found": P4_FOUND}
