"""Queries of the general data-preparation operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from calembour.operators import packed_values, row_parsing

MEANINGS = ["first_meaning", "second_meaning", "first_meaning_fr", "second_meaning_fr"]


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_values.unpack_values(spark.read.parquet(f"{sf_dir}/translated.parquet"), "rec_id", MEANINGS)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_parsing.bad_records(spark.read.parquet(f"{sf_dir}/raw_lines.parquet")).select("line_id", "reason")


def p6_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_parsing.good_records(spark.read.parquet(f"{sf_dir}/raw_lines.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p3_found, p6_found, p6_records)}


_FIELD = '(?:"(?:[^"]|"")*"|[^",]*)'
_ITEM = r"""(?:'(?:[^'\\]|\\(?:.|\n))*'|"(?:[^"\\]|\\(?:.|\n))*")"""
_BLANK = r"[ \t\r\n]*"
_LIST = rf"{_BLANK}\[{_BLANK}(?:{_ITEM}{_BLANK}(?:,{_BLANK}{_ITEM}{_BLANK})*)?\]{_BLANK}"


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _field(n: int) -> str:
    """The n-th of seven fields, without its quotes."""
    pattern = "^" + ",".join([_FIELD] * n + [f"({_FIELD})"] + [_FIELD] * (6 - n)) + "$"
    raw = f"regexp_extract(line, {_sql(pattern)}, 1)"
    return f"CASE WHEN {raw} LIKE '\"%' THEN replace(substr({raw}, 2, length({raw}) - 2), '\"\"', '\"') ELSE {raw} END"


_PARTS = f"""
WITH q AS (
  SELECT line_id, coalesce(line, '') AS line,
    regexp_full_match(coalesce(line, ''), {_sql(f"{_FIELD}(?:,{_FIELD})*")}) AS quoted,
    regexp_full_match(coalesce(line, ''), {_sql(f"{_FIELD}(?:,{_FIELD}){{6}}")}) AS seven
  FROM raw_lines),
f AS (SELECT line_id, quoted, seven, {", ".join(f"{_field(n)} AS f{n}" for n in range(7))} FROM q),
ok AS (
  SELECT *, regexp_full_match(f0, 'en_[0-9]+') AND trim(f1) <> '' AND lower(trim(f2)) IN ('homographic', 'homophonic')
    AND regexp_full_match(f6, '[0-9]+') AND {" AND ".join(f"regexp_full_match(f{n}, {_sql(_LIST)})" for n in (3, 4, 5))} AS valid
  FROM f)
"""

P6_FOUND = f"""{_PARTS}
SELECT line_id, CASE WHEN NOT quoted THEN 'quoting' WHEN NOT seven THEN 'column_count' ELSE 'value' END AS reason
FROM ok WHERE NOT (quoted AND seven AND valid)
"""


def oracle_sql() -> dict[str, str]:
    return {"p6_found": P6_FOUND}
