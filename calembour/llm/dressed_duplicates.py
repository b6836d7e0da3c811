"""Records that differ only in dress: case, blanks, punctuation, markup, field order.

A record is a bag of (field name, value) pairs. Every value is reduced to its letters
and digits, every pair is hashed, and the hashes are added modulo a prime. Addition
commutes, so the order of the fields cannot matter and nothing is sorted. Records are
grouped by two such sums (122 bits); then each member's fields are compared with those
of the group's keeper, so a collision can never merge two records.

Defined cases: null records and records whose ``required`` field has no letter or
digit are nobody's copy; other fields may be empty. Accents count. A record that is
neither a JSON object nor tab-separated ``name=value`` has no fields and is nobody's copy.
Unknown extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from calembour.operators.skew import salted_join
from calembour.session import checkpointed, ship

#: Prime modulus of the fingerprint lanes: two residues add without overflow.
PRIME = (1 << 61) - 1
PAIRS = "array<struct<name:string,value:string>>"


@F.pandas_udf(StringType())
def _compose(texts: pd.Series) -> pd.Series:
    return texts.map(lambda s: unicodedata.normalize("NFC", s), na_action="ignore")


def letters_and_digits(text: Column) -> Column:
    """Lower-case letters and digits of ``text`` in order; accents stay.

    Only texts with loose combining marks cross to Python to be composed.
    """
    loose = F.when(text.rlike(r"\p{M}"), text)
    whole = F.coalesce(_compose(loose), text)
    return F.lower(F.upper(F.regexp_replace(whole, r"[^\p{L}\p{N}\p{M}]|[\x{FE00}-\x{FE0F}]", "")))


def record_pairs(record: Column, names: list[str]) -> Column:
    """The (lower-case name, value) pairs of a JSON object or of tab-separated ``name=value``."""
    parsed = F.map_entries(F.from_json(record, "map<string,string>", {"allowUnescapedControlChars": "true"}))
    line = F.split(record, r"\t(?=\s*(?i:" + "|".join(names) + r")\s*=)")
    cut = F.transform(line, lambda p: F.struct(F.regexp_extract(p, r"^\s*(\w+)\s*=", 1).alias("key"), F.regexp_replace(p, r"^\s*\w+\s*=", "").alias("value")))
    pairs = F.when(record.rlike(r"^\s*\{"), parsed).otherwise(cut)
    return F.transform(pairs, lambda p: F.struct(F.lower(F.trim(p["key"])).alias("name"), p["value"].alias("value"))).cast(PAIRS)


def pairs_of_columns(columns: list[str]) -> Column:
    return F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns)).cast(PAIRS)


def _value(pairs: Column, name: str) -> Column:
    return F.try_element_at(F.filter(pairs, lambda p: p["name"] == name), F.lit(1))["value"]


def _once(df: DataFrame, key: str) -> DataFrame:
    """``df`` with its columns worked out once a row: the optimizer does not copy expressions through a generator."""
    return df.select(key, F.inline(F.array(F.struct(*(c for c in df.columns if c != key)))))


def fingerprints(df: DataFrame, key: str, pairs: Column, names: list[str], required: str) -> DataFrame:
    """``id``, ``fields`` (normalised pairs), ``f1``, ``f2`` of every record that can have copies."""
    ship(df.sparkSession)
    raw = _once(df.withColumn("__pairs", pairs).select(F.col(key).alias("id"), F.col("__pairs").alias("pairs")), "id")
    wide = _once(raw.select("id", *(F.coalesce(_value(F.col("pairs"), n), F.lit("")).alias(f"v{i}") for i, n in enumerate(names))), "id")
    norm = wide.select("id", *(letters_and_digits(F.col(f"v{i}")).alias(f"v{i}") for i in range(len(names))))
    fields = F.array(*(F.struct(F.lit(n).alias("name"), F.col(f"v{i}").alias("value")) for i, n in enumerate(names)))
    base = _once(norm, "id").where(F.col(f"v{names.index(required)}") != "").select("id", fields.alias("fields"))

    def lane(seed: int) -> Column:
        return F.aggregate("fields", F.lit(0).cast("bigint"), lambda a, p: (a + F.pmod(F.xxhash64(F.lit(seed), p["name"], p["value"]), F.lit(PRIME))) % F.lit(PRIME))

    return base.select("id", "fields", lane(11).alias("f1"), lane(7_919).alias("f2"))


def _same_fields(a: Column, b: Column) -> Column:
    return (F.size(a) == F.size(b)) & F.forall(a, lambda p: F.exists(b, lambda q: (q["name"] == p["name"]) & (q["value"] == p["value"])))


def copies(prints: DataFrame, total: int) -> DataFrame:
    """``keep_id``, ``dup_id``: every record beside its group's lowest id. ``total`` = rows behind ``prints``."""
    groups = prints.groupBy("f1", "f2").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # written once: only the records that have a fingerprint in common with another
    members = checkpointed(salted_join(prints, groups, ["f1", "f2"], "n", total, F.col("id")))
    keepers = members.where("id = keep_id").groupBy("f1", "f2", "keep_id", "n").agg(F.first("fields").alias("kept"))
    content = F.concat_ws("\x00", F.transform("fields", lambda p: F.concat_ws("=", p["name"], p["value"])))
    paired = salted_join(members.where("id <> keep_id").drop("keep_id", "n"), keepers, ["f1", "f2"], "n", total, F.col("id"))
    # the content is kept only where the fingerprint lied
    compared = checkpointed(paired.select("id", "keep_id", "f1", "f2", F.when(_same_fields(F.col("fields"), F.col("kept")), F.lit(None)).otherwise(content).alias("content")))
    verified = compared.where("content IS NULL").select("keep_id", F.col("id").alias("dup_id"))
    # records whose fingerprint collides with another content: grouped once more, by content
    strays = compared.where("content IS NOT NULL").drop("keep_id")
    kept = strays.groupBy("f1", "f2", "content").agg(F.min("id").alias("keep_id"))
    collided = strays.join(kept, ["f1", "f2", "content"]).where("id <> keep_id").select("keep_id", F.col("id").alias("dup_id"))
    return verified.unionByName(collided)


def table_copies(df: DataFrame, key: str, column: str) -> DataFrame:
    """Copies among the values of one text column."""
    return copies(fingerprints(df, key, pairs_of_columns([column]), [column], column), df.count())


def record_copies(df: DataFrame, key: str, record: str, names: list[str], required: str) -> DataFrame:
    """Copies among serialized records with the fields ``names``."""
    return copies(fingerprints(df, key, record_pairs(F.col(record), names), names, required), df.count())


def collapsed(found: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """One row per distinct record of ``df``: ``keep_id`` and ``copies`` (1 = it occurs once).

    Rows that cannot have copies (null, without letters and digits) stand for themselves.
    """
    found = checkpointed(found)
    counted = found.groupBy("keep_id").agg(F.count(F.lit(1)).alias("more"))
    kept = df.select(F.col(key).alias("keep_id")).join(found.select(F.col("dup_id").alias("keep_id")), "keep_id", "left_anti")
    return kept.join(counted, "keep_id", "left").select("keep_id", (1 + F.coalesce("more", F.lit(0))).alias("copies"))
