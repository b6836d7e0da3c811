"""A panel of evaluators over rounds: ratings, decisions, the best round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calembour.functions.text import justification, rating

# What each evaluator must give at least, in the panel's order.
THRESHOLDS = {"equivalence": 2, "mistranslation": 2, "emotion": 1, "authenticity": 3}
MOST_ROUNDS = 5


def rated(trace: DataFrame, response: str = "response") -> DataFrame:
    """``trace`` with ``rating`` and ``justification`` read from the responses."""
    return trace.withColumns({"rating": rating(F.col(response)), "justification": justification(F.col(response))})


def decisions(trace: DataFrame, key: str = "id_en", thresholds: dict[str, int] | None = None) -> DataFrame:
    """One row per ``key`` and ``iteration``: mean of the ratings that are there (0 without any), ``accepted``.

    A round is accepted only if every evaluator rated it and every rating meets its threshold.
    """
    need = thresholds or THRESHOLDS
    least = F.create_map(*(F.lit(x) for pair in need.items() for x in pair))
    known = rated(trace).where(F.col("evaluator").isin(list(need)))
    one = known.groupBy(key, "iteration", "evaluator").agg(F.min("rating").alias("rating"))
    return one.groupBy(key, "iteration").agg(
        F.coalesce(F.avg("rating"), F.lit(0.0)).alias("average"),
        F.count("rating").alias("n_ratings"),
        ((F.count("rating") == len(need)) & F.coalesce(F.bool_and(F.col("rating") >= F.try_element_at(least, F.col("evaluator"))), F.lit(False))).alias("accepted"),
    )


def best_iteration(trace: DataFrame, key: str = "id_en", most: int = MOST_ROUNDS, thresholds: dict[str, int] | None = None) -> DataFrame:
    """``key``, ``iteration``, ``best_score``, ``accepted``: the best round among those that took place.

    Rounds run up to the first accepted one, ``most`` at most; the greatest average
    wins, the earlier round on ties (so an accepted text can lose to an earlier one).
    """
    done = decisions(trace, key, thresholds).where(F.col("iteration") <= most)
    stops = done.groupBy(key).agg(F.min(F.when(F.col("accepted"), F.col("iteration"))).alias("stop"))
    ran = done.join(stops, key).where(F.col("stop").isNull() | (F.col("iteration") <= F.col("stop")))
    best = ran.groupBy(key).agg(F.max(F.struct("average", (-F.col("iteration")).alias("back"))).alias("b"), F.max("accepted").alias("accepted"))
    return best.select(key, (-F.col("b.back")).alias("iteration"), F.col("b.average").alias("best_score"), "accepted")


def last_iteration(trace: DataFrame, key: str = "id_en", most: int = MOST_ROUNDS) -> DataFrame:
    """The earlier variant: the accepted round, else the last one."""
    done = decisions(trace, key).where(F.col("iteration") <= most)
    return done.groupBy(key).agg(F.coalesce(F.min(F.when(F.col("accepted"), F.col("iteration"))), F.max("iteration")).alias("iteration"))


def feedback(trace: DataFrame, key: str = "id_en") -> DataFrame:
    """``key``, ``iteration``, ``feedback``: the justifications in the panel's order, a blank line between them."""
    names = list(THRESHOLDS)
    at = F.array_position(F.array(*map(F.lit, names)), F.col("evaluator"))
    rows = rated(trace).where(F.col("evaluator").isin(names))
    items = F.transform(F.array_sort(F.collect_list(F.struct(at.alias("o"), F.concat_ws(": ", "evaluator", "justification").alias("t")))), lambda r: r["t"])
    return rows.groupBy(key, "iteration").agg(F.concat(F.lit("KEY FEEDBACK:\n"), F.array_join(items, "\n\n")).alias("feedback"))
