"""External models behind one interface.

A provider answers prompts; where it runs is up to ``ask``: distinct prompts only, known
answers first, the rest in Arrow batches on the executors. An answer that is no JSON
object with the wanted fields gives nulls and an ``error``; it never stops the job and
never shifts columns, for fields are read by name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calembour.functions.text import json_slice, strict_json
from calembour.operators.layout import carried, frames, spread


class Provider(Protocol):
    def answer(self, prompts: list[str]) -> list[str]: ...


class Stub:
    """Answers by a rule; for tests and dry runs."""

    def __init__(self, rule: Callable[[str], str]):
        self.rule = rule

    def answer(self, prompts: list[str]) -> list[str]:
        return [self.rule(p) for p in prompts]


REGISTRY: dict[str, Callable[[], Provider]] = {}


def register(name: str, make: Callable[[], Provider]) -> None:
    REGISTRY[name] = make


def provider(name: str) -> Provider:
    if name not in REGISTRY:
        raise KeyError(f"no provider named {name!r}; known: {sorted(REGISTRY)}")
    return REGISTRY[name]()


def ask(df: DataFrame, prompt: str, model: Provider | None, recorded: DataFrame | None = None, response: str = "response") -> DataFrame:
    """``df`` with ``response``. ``recorded`` (prompt, response) is used first; each other distinct prompt is asked once.

    Without a model the misses stay null. An exception of the model becomes the
    response's text, marked by ``ERROR``.
    """
    wanted = df.select(F.col(prompt).alias("prompt")).where("prompt IS NOT NULL").distinct()
    known = None
    if recorded is not None:
        known = recorded.groupBy("prompt").agg(F.first("response").alias("response"))
        wanted = wanted.join(known.select("prompt"), "prompt", "left_anti")
    answers = known
    if model is not None:

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                prompts = b["prompt"].tolist()
                try:
                    got = model.answer(prompts)
                except Exception as e:  # noqa: BLE001
                    got = [f"ERROR {type(e).__name__}: {e}"] * len(prompts)
                yield pd.DataFrame({"prompt": prompts, "response": got})

        fresh = spread(wanted).mapInPandas(frames(run), "prompt string, response string")
        answers = fresh if answers is None else answers.unionByName(fresh)
    if answers is None:
        return df.withColumn(response, F.lit(None).cast("string"))
    return df.join(answers.select(F.col("prompt").alias(prompt), F.col("response").alias(response)), prompt, "left")


def parsed(df: DataFrame, schema: str, response: str = "response") -> DataFrame:
    """``df`` with the fields of ``schema`` read by name from the JSON object in ``response``, and ``error``."""
    cut = df.withColumn("__json", strict_json(json_slice(F.col(response))))
    out = cut.withColumn("__row", F.from_json("__json", schema, {"mode": "PERMISSIVE"}))
    error = F.when(F.col(response).isNull(), "no response").when(F.col(response).startswith("ERROR"), F.col(response)).when(F.col("__json").isNull(), "no JSON object")
    return out.withColumn("error", error).select(*df.columns, "__row.*", "error")


def loop(df: DataFrame, key: str, text: str, step: Callable[[str, int], tuple[str, bool]], most: int) -> DataFrame:
    """The full trace (``key``, ``iteration``, ``text``, ``stop``) of a rewriting loop, each row's loop in one place."""
    carry, way, kind = carried(df, key)
    source = spread(df.select(carry.alias("k"), F.col(text).cast("string").alias("t")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, t in zip(b["k"], b["t"], strict=True):
                now = t
                for i in range(1, most + 1):
                    now, stop = step(now, i)
                    rows.append((k, i, now, stop))
                    if stop:
                        break
            yield pd.DataFrame(rows, columns=["k", "iteration", "text", "stop"]).astype({"k": b["k"].dtype})

    return source.mapInPandas(frames(run), f"k {way}, iteration int, text string, stop boolean").select(F.col("k").cast(kind).alias(key), "iteration", "text", "stop")
