"""Exact nearest vectors of a stated set of queries among all rows.

The queries are cut into blocks of bounded size; each block goes to every task, which
multiplies it with its own vectors batch by batch and keeps its k best per query. Only
those k * tasks rows per query are shuffled. No pair of rows is ever materialized.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calembour.functions.vectors import normalised
from calembour.operators.layout import frames, spread

#: Queries in one block; at 1,000 dimensions a block has 16 MB.
BLOCK = 2_000


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1, n)


def top_k(corpus: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 5, unit: bool = True) -> DataFrame:
    """``query``, ``neighbour``, ``score``, ``rank``: the k rows most similar to each query, itself left out.

    Ties go to the lesser key. Rows with a null vector or key are neither found nor asked; a
    table with fewer rows gives fewer. ``queries`` is read on the driver block by block
    and must be a stated, small set.
    """
    asked = queries.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(key, vector).orderBy(key)
    source = spread(corpus.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("n"), F.col(vector).alias("v")))
    parts, block = [], []

    def search(rows: list) -> DataFrame:
        ids = np.array([r[0] for r in rows])
        ask = np.array([r[1] for r in rows], dtype=np.float64)
        ask = _unit(ask) if unit else ask

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best_s, best_n = np.full((len(ids), k), -np.inf), np.full((len(ids), k), -1, dtype=np.int64)
            for b in batches:
                if not len(b):
                    continue
                m = np.array(b["v"].tolist(), dtype=np.float64)
                m = _unit(m) if unit else m
                n = b["n"].to_numpy()
                s = ask @ m.T
                s[ids[:, None] == n[None, :]] = -np.inf
                both_s, both_n = np.hstack([best_s, s]), np.hstack([best_n, np.broadcast_to(n, s.shape)])
                # the least key first, then a stable sort by falling score rounded as it is reported
                order = np.argsort(both_n, axis=1, kind="stable")
                both_s, both_n = np.take_along_axis(both_s, order, 1), np.take_along_axis(both_n, order, 1)
                order = np.argsort(-np.round(both_s, 9), axis=1, kind="stable")[:, :k]
                best_s, best_n = np.take_along_axis(both_s, order, 1), np.take_along_axis(both_n, order, 1)
            q, j = np.nonzero(np.isfinite(best_s))
            yield pd.DataFrame({"query": ids[q], "neighbour": best_n[q, j], "score": best_s[q, j]})

        return source.mapInPandas(frames(run), "query bigint, neighbour bigint, score double")

    for r in asked.toLocalIterator():
        block.append(r)
        if len(block) == BLOCK:
            parts.append(search(block))
            block = []
    if block or not parts:
        parts.append(search(block) if block else source.select(F.col("n").alias("query"), F.col("n").alias("neighbour"), F.lit(0.0).alias("score")).where("false"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    w = Window.partitionBy("query").orderBy(F.round("score", 9).desc(), "neighbour")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def save_index(df: DataFrame, folder: str, key: str = "vec_id", vector: str = "embedding") -> None:
    """Unit vectors by key as Parquet: what ``top_k`` with ``unit=False`` takes for cosine search."""
    df.select(key, normalised(F.col(vector)).alias(vector)).write.mode("overwrite").parquet(folder)


def load_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def words_by_similarity(vocabulary: DataFrame, wanted: DataFrame, word: str = "word", key: str = "vec_id", vector: str = "embedding", k: int = 5) -> DataFrame:
    """The k words nearest to each wanted word. A repeated word stands for its last row; unknown words give no row."""
    last = vocabulary.groupBy(word).agg(F.max(key).alias(key))
    chosen = wanted.select(word).distinct().join(last, word).join(vocabulary.select(key, vector), key)
    found = top_k(vocabulary, chosen, key, vector, k)
    names = vocabulary.select(F.col(key).alias("neighbour"), F.col(word).alias("similar"))
    return found.join(chosen.select(F.col(key).alias("query"), word), "query").join(names, "neighbour").select(word, "similar", "score", "rank")
