"""The stages put together; every one takes and returns DataFrames."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calembour import schemas
from calembour.functions.text import TEMPLATES, clean_text, prompt
from calembour.functions.vectors import cosine, mean
from calembour.operators import lexicon, panel, providers, relational
from calembour.operators.layout import carried, frames, spread
from calembour.session import checkpointed


def clean_en(translation: DataFrame, order: str = "ord") -> DataFrame:
    """``id_en``, ``text_clean``: the first text of each id, cleaned."""
    first = relational.first_per_key(translation.select("id_en", "en", order), "id_en", order)
    return first.select("id_en", clean_text(F.coalesce("en", F.lit(""))).alias("text_clean"))


def combine_en(cleaned: DataFrame, manual: DataFrame) -> DataFrame:
    """``cleaned`` with manual labels by id; label columns it already has are replaced."""
    return cleaned.drop("manual_location", "manual_type", "manual_alternative").join(manual, "id_en", "left")


def clean_fr(translation: DataFrame) -> DataFrame:
    return translation.withColumn("text_clean", F.col("text_fr"))


def combine_fr(translation: DataFrame, inputs: DataFrame, qrels: DataFrame, order: str = "ord") -> DataFrame:
    """``id_en`` with the lists of its texts, of the ids with equal text, and of their locations.

    Blank and null texts are no key. Lists are in the order of ``order``, then id and location.
    """
    left = translation.select("id_en", "text_fr", order)
    by_text = left.join(inputs.where(F.trim("text") != "").select("id", F.col("text").alias("text_fr")), "text_fr", "left")
    every = by_text.join(qrels.select("id", "location"), "id", "left")
    at = F.struct(F.col(order), F.col("id"), F.col("location"))
    return every.groupBy("id_en").agg(
        relational.ordered_list(F.col("text_fr"), at).alias("text_fr"), relational.ordered_list(F.col("id"), at).alias("id"), relational.ordered_list(F.col("location"), at).alias("location")
    )


def contrastive_set(puns: DataFrame, others: DataFrame, text: str = "text_clean", other_text: str = "non_pun") -> DataFrame:
    """Both as one labelled set, ``target`` 1 and 0, in the order of row and target; other columns both have are kept."""
    a = puns.withColumn("target", F.lit(1))
    b = others.withColumn(text, F.col(other_text)).drop(other_text).withColumn("target", F.lit(0))
    shared = [c for c in a.columns if c in b.columns]
    return a.select(*shared).unionByName(b.select(*shared)).orderBy("row", "target")


def identify(df: DataFrame, model: providers.Provider | None, recorded: DataFrame | None = None) -> DataFrame:
    asked = df.withColumn("prompt", prompt("identify", text=F.col("text_clean")))
    return providers.parsed(providers.ask(asked, "prompt", model, recorded), schemas.IDENTIFIED).drop("prompt", "response")


def translate(df: DataFrame, model: providers.Provider | None, recorded: DataFrame | None = None, language: str = "French") -> DataFrame:
    values = F.to_json(F.struct("pun_word", "first_meaning", "second_meaning", "first_context", "second_context"))
    asked = df.withColumn("prompt", prompt("translate", language=F.lit(language), values=values))
    return providers.parsed(providers.ask(asked, "prompt", model, recorded), schemas.TRANSLATED).drop("prompt", "response")


def back_translate(df: DataFrame, model: providers.Provider | None, recorded: DataFrame | None = None, language: str = "French") -> DataFrame:
    """The translated fields in English again, under their names with ``_back`` behind."""
    fields = schemas.TRANSLATED.replace("_fr ", "_back ")
    values = F.to_json(F.struct(*(F.col(f.split()[0]).alias(f.split()[0].replace("_fr", "_back")) for f in schemas.TRANSLATED.split(", "))))
    asked = df.withColumn("prompt", prompt("back_translate", language=F.lit(language), values=values))
    return providers.parsed(providers.ask(asked, "prompt", model, recorded), fields).drop("prompt", "response")


def refine(df: DataFrame, model: providers.Provider, key: str, source: str, text: str, most: int = panel.MOST_ROUNDS, thresholds: dict[str, int] | None = None) -> DataFrame:
    """``key``, ``iteration``, ``evaluator``, ``response``, ``text``: the full trace of rating and rewriting each ``text``.

    A round asks every evaluator; unless all ratings meet their thresholds the text is
    rewritten with the feedback, ``most`` rounds at most. The rows of a batch go through
    a round together, so a model sees one request list per evaluator and round.
    """
    need = thresholds or panel.THRESHOLDS
    carry, way, kind = carried(df, key)
    rows = spread(df.select(carry.alias("k"), F.col(source).cast("string").alias("s"), F.col(text).cast("string").alias("t")).where("t IS NOT NULL"))

    def accepted(answers: dict[str, str]) -> bool:
        ratings = {e: re.search(r"Rating:\s*(\d+)", a or "") for e, a in answers.items()}
        return all(m and int(m[1]) >= need[e] for e, m in ratings.items())

    def notes(answers: dict[str, str]) -> str:
        found = {e: re.search(r"Justification:\s*(.*)", a or "", re.DOTALL) for e, a in answers.items()}
        return "KEY FEEDBACK:\n" + "\n\n".join(f"{e}: {m[1].strip() if m else 'No justification'}" for e, m in found.items())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            open_ = [(k, s if isinstance(s, str) else "", t) for k, s, t in zip(b["k"], b["s"], b["t"], strict=True)]
            trace = []
            for i in range(1, most + 1):
                answers = {e: model.answer([TEMPLATES["evaluate"] % (e, s, t) for _, s, t in open_]) for e in need}
                rejected = []
                for n, (k, s, t) in enumerate(open_):
                    mine = {e: a[n] for e, a in answers.items()}
                    trace += [(k, i, e, a, t) for e, a in mine.items()]
                    if not accepted(mine):
                        rejected.append((k, s, t, notes(mine)))
                if not rejected or i == most:
                    break
                better = model.answer([TEMPLATES["refine"] % (s, t, f) for _, s, t, f in rejected])
                open_ = [(k, s, new) for (k, s, _, _), new in zip(rejected, better, strict=True)]
            yield pd.DataFrame(trace, columns=["k", "iteration", "evaluator", "response", "text"]).astype({"k": b["k"].dtype})

    return rows.mapInPandas(frames(run), f"k {way}, iteration int, evaluator string, response string, text string").select(F.col("k").cast(kind).alias(key), "iteration", "evaluator", "response", "text")


def translate_puns(sentences: DataFrame, key: str, text: str, vocabulary: DataFrame, senses: DataFrame, distances: DataFrame, dictionary: DataFrame, words: DataFrame, related: DataFrame, synonyms: DataFrame) -> DataFrame:
    """``key``, ``kind``, ``word``, ``level``, ``pun``, ``confidence``, ``sentence`` of every sentence.

    The detector names a word and two meanings, the cascade looks for a French word that
    serves both, and the sentence is rewritten around it. Without a pun (``kind`` null),
    or without a hit, the words are translated one by one.
    """
    found = checkpointed(lexicon.detected_puns(sentences, vocabulary, senses, distances, key, text))
    solved = lexicon.polygons(found.select(F.col(key).alias("id"), "m1", "m2"), dictionary, words, related, synonyms).withColumnRenamed("id", key)
    known = checkpointed(sentences.select(key, text).join(found.select(key, "kind", "word"), key, "left").join(solved, key, "left"))
    told = known.withColumn("__pun", F.coalesce("pun", "fallback"))
    done = lexicon.rewritten(told.where(F.col(text).isNotNull()), dictionary, key, text, "word", "__pun")
    return known.select(key, "kind", "word", "level", F.coalesce("pun", "fallback").alias("pun"), "confidence").join(done, key, "left")


def similarity(df: DataFrame, vectors: DataFrame) -> DataFrame:
    """Six similarities of pun word and meanings in both languages from ``vectors`` (word, embedding).

    A meaning is the mean of its values' vectors; unknown values are left out.
    """
    parts = {f"{part}{lang}": values for lang in ("", "_fr") for part, values in (("word", F.array(f"pun_word{lang}")), ("first", F.col(f"first_meaning{lang}")), ("second", F.col(f"second_meaning{lang}")))}
    named = F.inline(F.array(*(F.struct(F.lit(k).alias("part"), v.alias("values")) for k, v in parts.items())))
    met = df.select("rec_id", named).select("rec_id", "part", F.explode("values").alias("word")).join(vectors.select("word", "embedding"), "word")
    # a record's few values meet in one row, for all six parts at once
    known = met.groupBy("rec_id").agg(F.collect_list(F.struct("part", "embedding")).alias("__met"))
    pooled = {k: mean(F.transform(F.filter("__met", lambda m: m["part"] == k), lambda m: m["embedding"])).alias(f"v_{k}") for k in parts}  # noqa: B023
    out = df.join(known.select("rec_id", *pooled.values()), "rec_id", "left")
    out = out.withColumns({f"{p}_similarity{'_en' if lang == '' else lang}": cosine(F.col(f"v_word{lang}"), F.col(f"v_{p}{lang}")) for lang in ("", "_fr") for p in ("first", "second")})
    out = out.withColumns({f"{p}_difference": F.col(f"{p}_similarity_en") - F.col(f"{p}_similarity_fr") for p in ("first", "second")})
    return out.drop(*(f"v_{k}" for k in parts))


def homonym(df: DataFrame, model: providers.Provider | None, recorded: DataFrame | None = None) -> DataFrame:
    """Three flags, -1 where the answer was no JSON, and the derived ``direct`` (homonym and both senses overlap)."""
    asked = df.withColumn("prompt", prompt("homonym", word=F.col("pun_word_fr"), a=F.array_join("first_meaning_fr", ", "), b=F.array_join("second_meaning_fr", ", ")))
    out = providers.parsed(providers.ask(asked, "prompt", model, recorded), schemas.HOMONYM).drop("prompt", "response")
    flags = ["is_homonym", "first_meaning_overlap", "second_meaning_overlap"]
    out = out.withColumns({f: F.when(F.col("error").isNotNull(), -1).otherwise(F.col(f)) for f in flags})
    return out.withColumn("direct", ((F.col(flags[0]) == 1) & (F.col(flags[1]) == 1) & (F.col(flags[2]) == 1)).cast("int"))


def generate(df: DataFrame, model: providers.Provider | None, recorded: DataFrame | None = None) -> DataFrame:
    asked = df.withColumn("prompt", prompt("generate", word=F.col("pun_word_fr"), other=F.array_join("second_meaning_fr", ", "), text=F.col("text_clean")))
    return providers.parsed(providers.ask(asked, "prompt", model, recorded), schemas.GENERATED).drop("prompt", "response")


def few_shot_context(df: DataFrame, text: str, target: str, key: str, size: int = 25) -> DataFrame:
    """One row, ``context``: ``size`` examples of each class, one a line, puns first. At most 2 * size rows meet."""
    rows = relational.stratified(df.select(key, text, target), target, key, size)
    line = F.when(F.col(target) == 1, F.concat(F.lit("Contains a pun: "), F.col(text))).otherwise(F.concat(F.lit("Does not contain a pun: "), F.col(text)))
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col(target)).alias("c"), relational.portable_order(key).alias("o"), F.col(key).alias("k"), line.alias("t")))), lambda r: r["t"]), "\n").alias("context"))


def judge(df: DataFrame, examples: DataFrame, model: providers.Provider | None, recorded: DataFrame | None = None) -> DataFrame:
    """``is_pun`` of ``generated_pun``; the context of at most fifty examples is one short text."""
    context = examples.first()["context"]
    asked = df.withColumn("prompt", prompt("judge", context=F.lit(context), text=F.col("generated_pun")))
    return providers.parsed(providers.ask(asked, "prompt", model, recorded), schemas.JUDGED).drop("prompt", "response")


def alternative_words(df: DataFrame, word: str, manual: str, verdict: str) -> DataFrame:
    """``match``: 1 where word and manual word are equal, else the model's ``verdict``; ``predicted``: the manual word or 'false'."""
    same = F.lower(F.trim(word)) == F.lower(F.trim(manual))
    hit = F.when(same, 1).otherwise(F.coalesce(F.col(verdict), F.lit(0)))
    return df.withColumn("match", hit).withColumn("predicted", F.when(F.col("match") == 1, F.col(manual)).otherwise("false"))


def compared_lists(df: DataFrame, key: str, source: str, back: str, similarities: DataFrame | None = None) -> DataFrame:
    """``key``, ``mean_similarity``, ``problems`` of two aligned lists.

    Equal items count 1, others their ``similarities`` (a, b, similarity) or 0; items
    beyond the back list are no comparison, and a longer source list is one problem.
    """
    n = F.least(F.size(source), F.size(back))
    problem = (F.size(F.coalesce(source, F.array().cast("array<string>"))) > F.size(F.coalesce(back, F.array().cast("array<string>")))).cast("int")
    base = df.select(key, problem.alias("problems"))
    pairs = df.where(n > 0).select(key, F.explode(F.slice(F.arrays_zip(F.col(source).alias("a"), F.col(back).alias("b")), F.lit(1), n)).alias("z")).select(key, "z.a", "z.b")
    same = F.col("a").eqNullSafe(F.col("b"))
    if similarities is None:
        value = F.when(same, 1.0).otherwise(0.0)
    else:
        pairs = pairs.join(similarities.select("a", "b", "similarity"), ["a", "b"], "left")
        value = F.when(same, 1.0).otherwise(F.coalesce("similarity", F.lit(0.0)))
    means = pairs.groupBy(key).agg(F.avg(value).alias("mean_similarity"))
    return base.join(means, key, "left")


def length_by_target(df: DataFrame, text: str, target: str) -> DataFrame:
    return df.groupBy(target).agg(F.avg(F.length(text)).alias("mean_length"), F.count(F.lit(1)).alias("n"))


def sweep(prompts: DataFrame, models: list[str], temperatures: list[float]) -> DataFrame:
    """Every prompt with every model and temperature: both lists are short and part of the call."""
    return prompts.withColumn("model", F.explode(F.array(*map(F.lit, models)))).withColumn("temperature", F.explode(F.array(*map(F.lit, temperatures))))
