"""How rows are laid out over tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calembour.session import ship


def carried(df: DataFrame, key: str) -> tuple[Column, str, str]:
    """``key`` as Python may carry it, its type on the way and its own type.

    Whole numbers go as text: pandas would turn them into floats beside a null, and large
    ones into their neighbours.
    """
    kind = df.schema[key].dataType.simpleString()
    way = "string" if kind in ("tinyint", "smallint", "int", "bigint") else kind
    return F.col(f"`{key}`").cast(way), way, kind


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores.

    For Python-heavy work on tables of a few small files; a table that already comes in
    enough partitions is left as it is, without a shuffle. Python workers can import
    this package afterwards.
    """
    ship(df.sparkSession)
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def frames(run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """``run`` without empty batches on either side: an empty frame has no types to go by."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for out in run(b for b in batches if len(b)):
            if len(out):
                yield out

    return go
