"""All queries of the library outside ``llm``, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calembour.functions.text import words
from calembour.operators.relational import first_per_key
from calembour.plans import composite_queries, data_queries, lexicon_queries, text_queries

MODULES = (data_queries, text_queries, lexicon_queries, composite_queries)


def _flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents once per text, white space normalised, with their hand label, mean length by label."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/doc_labels.parquet").groupBy("doc_id").agg(F.min("kind").alias("kind"))
    clean = first_per_key(docs, "text", "doc_id").select("doc_id", F.array_join(words(F.col("text")), " ").alias("text_clean"))
    return clean.join(labels, "doc_id", "left").groupBy(F.coalesce("kind", F.lit("")).alias("kind")).agg(F.avg(F.length("text_clean")).alias("mean_length"), F.count(F.lit(1)).alias("n"))


FLAGSHIP_SQL = f"""
WITH f AS (SELECT min(doc_id) AS doc_id, text FROM documents WHERE text IS NOT NULL GROUP BY text),
c AS (SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(text, {text_queries.lit(text_queries.T.BLANK + "+")}), lambda x: x <> ''), ' ') AS t FROM f),
l AS (SELECT doc_id, min(kind) AS kind FROM doc_labels GROUP BY doc_id)
SELECT coalesce(kind, '') AS kind, avg(length(t)) AS mean_length, count(*) AS n FROM c LEFT JOIN l ON c.doc_id = l.doc_id GROUP BY 1
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"flagship": _flagship} | {k: f for m in MODULES for k, f in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {"flagship": FLAGSHIP_SQL} | {k: s for m in MODULES for k, s in m.oracle_sql().items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flagship(spark, sf_dir)
