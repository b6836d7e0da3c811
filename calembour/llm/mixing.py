"""A mix of sources with target shares, in tokens.

Every source gets ``target_share`` of ``total`` tokens (by default as many as all its
sources' documents have together), but no document more than ``max_repeats`` times.
Whole epochs of a source come first; what is left of its budget is drawn without
replacement by exponential keys -ln(u)/w (Efraimidis and Spirakis), w being a quality
weight: the documents with the smallest keys until their tokens fill the budget, the
last one if at least half of it fits.

No source is ever sorted as a whole. Approximate quantiles of the keys cut each source
into BUCKETS buckets whose token sums say which bucket holds the end of the budget. That
bucket is cut again until it has no more than BORDER rows (or its keys are all the same),
and only those are put in order. The quantiles decide how the work is cut, not which
documents are drawn.

Defined cases: source names are compared in lower case with ``_`` between words;
documents with a null or unlisted source are no part of the mix, nor are those without
tokens (null or empty texts); a source without documents reaches a share of zero, and
like a capped one leaves its part of the total unfilled; repeated target rows count
once (the largest share); a repeated document id is drawn by row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calembour.llm.text_quality import Layout, doubled
from calembour.llm.tokenizing import BYTE_BPE_50K, vocabulary
from calembour.operators.layout import carried, frames, spread
from calembour.session import checkpointed

BUCKETS = 200
#: Rows of one source that one task may put in order.
BORDER = 100_000
LEAST_WEIGHT = 0.1


def source_name(column: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.trim(column)), r"[^\p{L}\p{N}]+", "_"), F.lit("_"))


def sized(df: DataFrame, key: str, text: str, source: str, path: str, seed: int) -> DataFrame:
    """``id``, ``source``, ``tokens``, ``weight`` and the exponential ``k`` of each document with tokens."""
    carry, way, kind = carried(df, key)
    rows = spread(df.select(carry.alias("id"), source_name(F.col(source)).alias("source"), F.col(text).cast("string").alias("t")).where("source IS NOT NULL AND t <> ''"))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(path)
        for b in batches:
            texts = b["t"].tolist()
            weights = []
            for t in texts:
                quality = 0.0
                if t.strip():
                    laid = Layout(t)
                    quality = laid.sentence_share() * (1 - doubled(laid.sentences))
                weights.append(LEAST_WEIGHT + (1 - LEAST_WEIGHT) * quality)
            yield pd.DataFrame({"id": b["id"], "source": b["source"], "tokens": [len(x) for x in v.encode_batch(texts)], "weight": weights})

    u = (F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return rows.mapInPandas(frames(measure), f"id {way}, source string, tokens bigint, weight double").where("tokens > 0").withColumn("id", F.col("id").cast(kind)).withColumn("k", -F.log(u) / F.col("weight"))


def plan(documents: DataFrame, targets: DataFrame, total: int | None) -> DataFrame:
    """One row per source of ``targets``: sizes, budget, whole epochs, tokens left to draw (``rest``)."""
    goal = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").where("source IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    have = documents.groupBy("source").agg(F.sum("tokens").alias("available_tokens"), F.count(F.lit(1)).alias("n_documents"))
    joined = goal.join(have, "source", "left").na.fill(0, ["available_tokens", "n_documents"])
    whole = F.lit(total).cast("double") if total is not None else F.sum("available_tokens").over(Window.partitionBy()).cast("double")
    budget = F.least(F.col("target_share") * whole, (F.col("max_repeats") * F.col("available_tokens")).cast("double"))
    return (
        joined.withColumn("wanted_tokens", F.col("target_share") * whole)
        .withColumn("budget", budget)
        .withColumn("epochs", F.when(F.col("available_tokens") > 0, F.floor(F.col("budget") / F.col("available_tokens"))).otherwise(F.lit(0)).cast("int"))
        .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("available_tokens"))
    )


def drawn(docs: DataFrame, sources: DataFrame, border: int = BORDER) -> DataFrame:
    """``docs`` (``source``, ``id``, ``tokens``, ``k``) with the ``epochs`` of their source and ``drawn``: whether the fractional draw takes them once more."""
    points = [i / BUCKETS for i in range(1, BUCKETS)]
    undecided = docs.join(F.broadcast(sources.select("source", "epochs", "rest")), "source")  # one row per target source
    decided, left = [], -1
    while True:
        edges = undecided.groupBy("source").agg(F.percentile_approx("k", points).alias("edges"))  # BUCKETS numbers a source
        cut = undecided.join(F.broadcast(edges), "source").withColumn("bucket", F.size(F.filter("edges", lambda e: e < F.col("k")))).drop("edges")
        sums = cut.groupBy("source", "bucket").agg(F.sum("tokens").alias("s"), F.first("rest").alias("left"))
        up_to = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        # at most BUCKETS rows a source
        edge = (
            sums.withColumn("before", F.coalesce(F.sum("s").over(up_to), F.lit(0)))
            .where("before < left")
            .groupBy("source")
            .agg(F.max("bucket").alias("last"), F.max_by("before", "bucket").alias("before"))
        )
        placed = cut.join(F.broadcast(edge), "source", "left")
        decided.append(placed.where("bucket < last").withColumn("drawn", F.lit(1)))
        decided.append(placed.where("last IS NULL OR bucket > last").withColumn("drawn", F.lit(0)))
        undecided = checkpointed(placed.where("bucket = last").withColumn("rest", F.col("rest") - F.col("before")).drop("bucket", "last", "before"))
        was, most = left, undecided.groupBy("source").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
        left = most["all"] or 0
        if (most["most"] or 0) <= border or left == was:
            break
    running = Window.partitionBy("source").orderBy("k", "id").rowsBetween(Window.unboundedPreceding, 0)
    decided.append(undecided.withColumn("drawn", (F.sum("tokens").over(running) - F.col("tokens") / 2 <= F.col("rest")).cast("int")))
    return reduce(DataFrame.unionByName, [d.select("id", "source", "tokens", "epochs", "drawn") for d in decided])


def mix(documents: DataFrame, targets: DataFrame, total: int | None = None, key: str = "doc_id", text: str = "text", source: str = "source", path: str = BYTE_BPE_50K, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(``key``, ``source``, ``tokens``, ``copies``) of every document in the mix, and the report of shares by source."""
    listed = targets.select(source_name(F.col("source")).alias("source")).distinct()
    docs = checkpointed(sized(documents, key, text, source, path, seed).join(F.broadcast(listed), "source", "left_semi"))
    sources = checkpointed(plan(docs, targets, total))  # one row per target source
    chosen = drawn(docs, sources).select(F.col("id").alias(key), "source", "tokens", (F.col("epochs") + F.col("drawn")).cast("int").alias("copies")).where("copies > 0")
    taken = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"), F.count(F.lit(1)).alias("mixed_documents"), F.max("copies").alias("most_copies"))
    report = (
        sources.join(taken, "source", "left")
        .na.fill(0, ["mixed_tokens", "mixed_documents", "most_copies"])
        .withColumn("actual_share", F.round(F.try_divide(F.col("mixed_tokens"), F.sum("mixed_tokens").over(Window.partitionBy())), 6))
        .withColumn("capped", F.col("wanted_tokens") > F.col("max_repeats") * F.col("available_tokens"))
        .select("source", "target_share", "actual_share", "max_repeats", "most_copies", "n_documents", "mixed_documents", "available_tokens", F.round("wanted_tokens", 1).alias("wanted_tokens"), "mixed_tokens", "capped")
    )
    return chosen, report
