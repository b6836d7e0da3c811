"""Wordplay search over lexicon tables.

Tables: lexicon(word, phon, ord), related(word, term, weight, ord), dictionary(en, fr,
ord), synonyms(word, synonym), senses(word, ord, sense, label), distances(s1, s2, d).
All lookups are joins; every limit on a key is applied before the next join, and pairs
that a lower level has solved do not enter the next one.
"""

from __future__ import annotations

import difflib
import itertools
import math
import operator
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calembour.functions import text as T
from calembour.functions.text import content_tokens
from calembour.functions.vectors import capped_score
from calembour.operators.layout import frames
from calembour.operators.relational import per_key_limit
from calembour.session import checkpointed, ship

LEAST_SIMILARITY = 0.25
MOST_HOMOPHONES = 30
#: A lookup table of so many rows at most is sent to all tasks.
SENT_ROWS = 20_000


def sized(df: DataFrame) -> DataFrame:
    """``df`` worked out once; sent to all tasks where its rows were counted to be few enough."""
    df = checkpointed(df)
    return F.broadcast(df) if df.count() <= SENT_ROWS else df


def phonetic_index(lexicon: DataFrame) -> DataFrame:
    """``phon``, ``words``: the words of each sound, once each, in stored order. Blank entries are skipped."""
    rows = lexicon.select(F.lower(F.trim("word")).alias("word"), F.trim("phon").alias("phon"), "ord").where("word <> '' AND phon <> ''")
    first = rows.groupBy("phon", "word").agg(F.min("ord").alias("ord"))
    return first.groupBy("phon").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "word"))), lambda r: r["word"]).alias("words"))


def sounds(lexicon: DataFrame, limit: int = MOST_HOMOPHONES) -> tuple[DataFrame, DataFrame]:
    """``word``, ``phon``, ``at`` and ``phon``, ``homophone``, ``pos``: the sound of each word's last entry, and the words that a sound offers.

    A word only ever needs the first limit + 1 words of its sound, so each sound keeps
    that many, numbered in stored order; ``at`` is the word's own number, if it is among
    them. A sound shared by a third of the lexicon makes limit + 1 rows, not a square.
    """
    rows = lexicon.select(F.lower(F.trim("word")).alias("word"), F.trim("phon").alias("phon"), "ord").where("word <> '' AND phon <> ''")
    sound = rows.groupBy("word").agg(F.max_by("phon", "ord").alias("phon"))
    first = rows.groupBy("phon", "word").agg(F.min("ord").alias("ord"))
    w = Window.partitionBy("phon").orderBy("ord", "word")
    offered = first.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= limit + 1).select("phon", F.col("word").alias("homophone"), "pos")
    own = offered.select("phon", F.col("homophone").alias("word"), F.col("pos").alias("at"))
    return sound.join(own, ["phon", "word"], "left").select("word", "phon", "at"), offered


def homophone_rank() -> Column:
    """The number of ``homophone`` among the other words of the sound: ``pos``, less one behind the word itself."""
    return F.col("pos") - F.coalesce((F.col("at") < F.col("pos")).cast("int"), F.lit(0))


def homophones(lexicon: DataFrame, limit: int = MOST_HOMOPHONES) -> DataFrame:
    """``word``, ``homophone``, ``rank``: other words with the sound of the word's last entry, ``limit`` at most, in stored order."""
    sound, offered = sounds(lexicon, limit)
    met = sound.join(offered, "phon").where("word <> homophone").withColumn("rank", homophone_rank())
    return met.where(F.col("rank") <= limit).select("word", "homophone", "rank")


def relatedness(pairs: DataFrame, related: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with ``score``: the greater weight of either direction over 10, at most 1; equal words 1, blank or unrelated ones 0."""
    weights = related.groupBy("word", "term").agg(F.max("weight").alias("weight"))
    ab = weights.select(F.col("word").alias("a"), F.col("term").alias("b"), F.col("weight").alias("ab"))
    ba = weights.select(F.col("word").alias("b"), F.col("term").alias("a"), F.col("weight").alias("ba"))
    both = pairs.join(ab, ["a", "b"], "left").join(ba, ["a", "b"], "left")
    best = F.greatest(F.coalesce("ab", F.lit(0.0)), F.coalesce("ba", F.lit(0.0)))
    return both.withColumn("score", capped_score(F.col("a"), F.col("b"), best)).drop("ab", "ba")


def close_terms(related: DataFrame) -> DataFrame:
    """``a``, ``b``, ``score``: all pairs of different words whose relatedness is at least LEAST_SIMILARITY, in either direction."""
    ab = related.select(F.col("word").alias("a"), F.col("term").alias("b"), "weight")
    both = ab.unionByName(ab.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")).groupBy("a", "b").agg(F.max("weight").alias("weight"))
    rated = both.where(T.key_form(F.col("a")) != T.key_form(F.col("b"))).select("a", "b", capped_score(F.col("a"), F.col("b"), F.col("weight")).alias("score"))
    return rated.where(F.col("score") >= LEAST_SIMILARITY)


def translate(df: DataFrame, dictionary: DataFrame, column: str, to: str, order: str) -> DataFrame:
    """Each translation of ``column`` in ``to``, its rank in ``order``; a word without one, or a blank one, stays as it is."""
    entries = dictionary.select(F.lower(F.trim("en")).alias("__en"), F.lower("fr").alias(to), F.col("ord").alias(order))
    found = df.withColumn("__en", F.lower(F.trim(column))).join(entries, "__en", "left").drop("__en")
    return found.withColumn(to, F.coalesce(to, F.col(column))).withColumn(order, F.coalesce(order, F.lit(0).cast("bigint")))


def _strong(related: DataFrame, least: float, most: int) -> DataFrame:
    """The first ``most`` terms of each word above a raw weight."""
    return per_key_limit(related.where(F.col("weight") > least), ["word"], [F.col("ord"), F.col("term")], most).select("word", "term", F.col("ord").alias("term_ord"))


def polygons(seeds: DataFrame, dictionary: DataFrame, lexicon: DataFrame, related: DataFrame, synonyms: DataFrame, highest: int = 8) -> DataFrame:
    """``id``, ``level``, ``pun``, ``confidence``, ``fallback`` of each seed (id, m1, m2).

    Level 4 asks for one translation of both meanings, 5 for a homophone of the first
    related to the second, 6 for the same over English synonyms, 7 and 8 for longer
    chains of related words and homophones. The first hit in the order of the chain's
    steps counts; without one ``fallback`` is the first translation of m1.
    """
    dictionary, related, synonyms = sized(dictionary), sized(related), sized(synonyms)
    # the answer depends on the meanings only: each pair of them is solved once, however many seeds have it
    asked = checkpointed(seeds.select("m1", "m2").distinct().withColumn("id", F.monotonically_increasing_id()))
    sound, offered = map(checkpointed, sounds(lexicon))
    close = sized(close_terms(related))
    t1 = checkpointed(translate(asked.select("id", "m1"), dictionary, "m1", "t1", "o1"))
    t2 = checkpointed(translate(asked.select("id", "m2"), dictionary, "m2", "t2", "o2").select("id", "t2", "o2"))
    same = t2.select("id", T.key_form(F.col("t2")).alias("end"), "o2", F.lit(1.0).alias("score")).where("end <> ''")

    def hop(df: DataFrame, column: str, to: str, most: int) -> DataFrame:
        met = df.join(sound.withColumnRenamed("word", column), column).join(offered.where(F.col("pos") <= most + 1), "phon").where(F.col(column) != F.col("homophone"))
        ranked = met.withColumn(f"o_{to}", homophone_rank()).where(F.col(f"o_{to}") <= most)
        return ranked.withColumnRenamed("homophone", to).drop("phon", "at", "pos")

    def relate(df: DataFrame, column: str, to: str, least: float, most: int) -> DataFrame:
        r = _strong(related, least, most)
        return df.join(r.select(F.col("word").alias(column), F.col("term").alias(to), F.col("term_ord").alias(f"o_{to}")), column)

    def best(scored: DataFrame, pun: str, level: int, factor: float, order: list[str]) -> DataFrame:
        first = scored.groupBy("id").agg(F.min(F.struct(*order, "o2", F.col(pun).alias("pun"), F.col("score").alias("score"))).alias("hit"))
        return first.select("id", F.lit(level).alias("level"), F.col("hit.pun").alias("pun"), (F.col("hit.score") * factor).alias("confidence"))

    def solve(chain: DataFrame, end: str, pun: str, level: int, factor: float, order: list[str]) -> DataFrame:
        """Chains whose ``end`` is the second meaning or related to it; only such pairs are ever built."""
        columns = ["id", *order, pun, "o2", "score"]
        equal = chain.withColumn("end", T.key_form(F.col(end))).join(same, ["id", "end"]).select(columns)
        near = chain.join(close.withColumnsRenamed({"a": end, "b": "t2"}), end).join(t2, ["id", "t2"]).select(columns)
        return best(equal.unionByName(near), pun, level, factor, order)

    def sounding(chain: DataFrame, column: str, level: int, factor: float, order: list[str]) -> DataFrame:
        """As ``solve`` where the end is a homophone ``h`` of ``column``: asked from the second meaning, which has few relatives, not from all homophones."""
        near = t2.join(close.select(F.col("a").alias("end"), F.col("b").alias("t2"), "score"), "t2").select("id", "end", "o2", "score")
        ends = chain.join(same.unionByName(near), "id").where(F.col(column) != F.col("end"))
        met = ends.join(sound.withColumnRenamed("word", column), column).join(offered.withColumnRenamed("homophone", "end"), ["phon", "end"])
        ranked = met.withColumns({"o_h": homophone_rank(), "h": F.col("end")}).where(F.col("o_h") <= MOST_HOMOPHONES)
        return best(ranked, "h", level, factor, order)

    def square(open_: DataFrame) -> DataFrame:
        both = open_.join(t2, "id").where("t1 = t2").groupBy("id").agg(F.min(F.struct("o1", "o2", "t1")).alias("hit"))
        return both.select("id", F.lit(4).alias("level"), F.col("hit.t1").alias("pun"), F.lit(1.0).alias("confidence"))

    def hexagon(open_: DataFrame) -> DataFrame:
        base = open_.select("id", F.lower(F.trim("m1")).alias("word")).distinct()
        more = synonyms.select("word", "synonym").where("synonym <> word").distinct()
        every = base.select("id", F.col("word").alias("syn"), F.lit(0).alias("kind")).unionByName(base.join(more, "word").select("id", F.col("synonym").alias("syn"), F.lit(1).alias("kind")))
        kept = per_key_limit(every, ["id"], [F.col("kind"), F.col("syn")], 12)
        return sounding(translate(kept, dictionary, "syn", "fr", "o_fr"), "fr", 6, 1.0, ["kind", "syn", "o_fr", "o_h"])

    def heptagon(open_: DataFrame) -> DataFrame:
        few = per_key_limit(open_, ["id"], [F.col("o1")], 3)
        return solve(relate(hop(relate(few, "t1", "s", 3.0, 10), "s", "h", 10), "h", "r", 3.0, 10), "r", "h", 7, 0.8, ["o1", "o_s", "o_h", "o_r"])

    def octagon(open_: DataFrame) -> DataFrame:
        few = per_key_limit(open_, ["id"], [F.col("o1")], 2)
        chain = hop(relate(hop(relate(few, "t1", "s", 4.0, 5), "s", "h", 5), "h", "r", 4.0, 5), "r", "g", 5)
        return solve(chain, "g", "g", 8, 0.6, ["o1", "o_s", "o_h", "o_r", "o_g"])

    steps = {4: square, 5: lambda o: sounding(o, "t1", 5, 1.0, ["o1", "o_h"]), 6: hexagon, 7: heptagon, 8: octagon}
    solved: list[DataFrame] = []
    open_ = t1
    for level in range(4, min(highest, 8) + 1):
        now = checkpointed(steps[level](open_))
        solved.append(now)
        open_ = open_.join(now.select("id"), "id", "left_anti")
    hits = reduce(DataFrame.unionByName, solved)
    literal = t1.groupBy("id").agg(F.min_by("t1", "o1").alias("literal"))
    solved_once = asked.join(literal.join(hits, "id", "left"), "id").drop("id").withColumnsRenamed({"m1": "a", "m2": "b"})
    found = seeds.join(solved_once, F.col("m1").eqNullSafe(F.col("a")) & F.col("m2").eqNullSafe(F.col("b")))
    return found.select("id", "level", "pun", "confidence", F.when(F.col("level").isNull(), F.col("literal")).alias("fallback"))


def longest_subword(words: DataFrame, vocabulary: DataFrame, least: int = 4) -> DataFrame:
    """``word``, ``sub``: the longest stretch of at least ``least`` letters that is itself a known word; the leftmost on ties.

    Words of any length are searched; no stretch is longer than the longest known word,
    so stretches grow with a word's length times that.
    """
    known = vocabulary.select(F.col("word").alias("sub")).distinct()
    longest = known.agg(F.coalesce(F.max(F.length("sub")), F.lit(0)).alias("longest"))
    stretches = (
        words.select("word").distinct().where(F.length("word") >= least).crossJoin(F.broadcast(longest)).where(F.col("longest") >= least)
        .select("word", "longest", F.explode(F.sequence(F.lit(1), F.length("word") - least + 1)).alias("i"))
        .select("word", "i", F.explode(F.sequence(F.lit(least), F.least(F.length("word") - F.col("i") + 1, F.col("longest")))).alias("n"))
        .select("word", "i", "n", F.expr("substring(word, i, n)").alias("sub"))
    )
    return stretches.join(known, "sub").groupBy("word").agg(F.max_by("sub", F.struct("n", -F.col("i"))).alias("sub"))


#: Words of so many letters at most meet on what is left of them, longer ones on letter pairs.
SHORT_WORD = 13


def least_matched(letters: int, cutoff: float) -> int:
    """The fewest matched letters with which two words of ``letters`` letters together reach ``cutoff``."""
    m = int(cutoff * letters / 2)
    while m and 2.0 * (m - 1) / letters >= cutoff:
        m -= 1
    while 2.0 * m / letters < cutoff:
        m += 1
    return m


@lru_cache(maxsize=None)
def _kept(letters: int, left: int) -> np.ndarray:
    """The places that ``left`` of so many letters can have, one choice a row."""
    return np.array(list(itertools.combinations(range(letters), left)), dtype=np.intp).reshape(-1, left)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def remainders(words: list[str], cutoff: float, asked: bool) -> tuple[np.ndarray, np.ndarray]:
    """What short words must share to reach ``cutoff``: for every length of the other word, all that can be left of a word when it
    has lost the letters it may lose. Numbers of the words in ``words``, and the remainders as 64-bit numbers.

    All words of one length are worked on together.
    """
    at, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(lengths[(lengths > 0) & (lengths <= SHORT_WORD)]).tolist():
        rows = np.flatnonzero(lengths == n)
        letters = np.frombuffer("".join(words[i] for i in rows).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n).astype(np.uint64)
        for other in range(1, SHORT_WORD + 1):
            left = least_matched(n + other, cutoff)
            if left > min(n, other):
                continue
            kept = _kept(n, left)
            h = _mixed(np.full((len(rows), len(kept)), 100 * n + other if asked else 100 * other + n, np.uint64))
            for j in range(left):
                h = _mixed(h + letters[:, kept[:, j]])
            # a doubled letter leaves the same remainder twice
            h.sort(axis=1)
            once = np.ones(h.shape, bool)
            once[:, 1:] = h[:, 1:] != h[:, :-1]
            at.append(np.repeat(rows, len(kept))[once.ravel()])
            keys.append(h[once])
    return np.concatenate(at), np.concatenate(keys)


def _at_work(df: DataFrame, key: str) -> DataFrame:
    """``df`` by ``key`` in as many tasks as a shuffle has, at least one a core: its rows cost Python far more to work on than to move."""
    spark = df.sparkSession
    ship(spark)
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


def meeting_words(words: DataFrame, vocabulary: DataFrame, cutoff: float) -> DataFrame:
    """``word``, ``close``: pairs of different words, once each; all those with a matching-blocks ratio of at least ``cutoff`` are among them.

    Matching blocks are a common subsequence, and the ratio and both lengths say how long
    it is at least. Words of up to SHORT_WORD letters meet on such a remainder, which few
    words share however large the vocabulary. Pairs with a longer word meet on letter
    pairs (ends of words included) and must share as many as the ratio leaves whole: each
    unmatched letter parts one pair of matched neighbours.
    """
    bound = cutoff / (2 - cutoff)  # ratio = 2m/(a+b) >= c bounds the lengths: min/max >= c/(2-c)
    asked = checkpointed(words.select("word").distinct().where("word <> ''"))
    known = checkpointed(vocabulary.select(F.col("word").alias("close")).distinct().where("close <> ''"))

    def left_of(df: DataFrame, c: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, len(b), 1000):
                    part = b.column(0).slice(at, 1000)
                    rows, keys = remainders(part.to_pylist(), cutoff, c == "word")
                    yield pa.RecordBatch.from_arrays([part.take(pa.array(rows)), pa.array(keys.view(np.int64))], [c, "k"])

        return _at_work(df.where(F.length(c) <= SHORT_WORD), c).mapInArrow(run, f"{c} string, k bigint")

    def grams(df: DataFrame, c: str, least: float) -> DataFrame:
        """``g``: letter pairs, each with its number among equal ones, so that common ones count as often as both words have them."""
        text = F.concat(F.lit("^"), F.col(c), F.lit("$"))
        pair = lambda i: F.substring(text, i, F.lit(2))
        each = df.where(F.length(c) >= least).select(c, F.explode(F.transform(F.sequence(F.lit(1), F.length(text) - 1), pair)).alias("g"))
        counted = each.groupBy(c, "g").agg(F.count(F.lit(1)).cast("int").alias("n"))
        return counted.select(c, "g", F.explode(F.sequence(F.lit(1), "n")).alias("n"))

    la, lb = F.length("word"), F.length("close")
    near = left_of(asked, "word").join(left_of(known, "close"), "k").select("word", "close")
    least = math.ceil(bound * (SHORT_WORD + 1) - 1e-9)
    a, k = grams(asked, "word", least), grams(known, "close", least)
    long_a, long_k = F.length("word") > SHORT_WORD, F.length("close") > SHORT_WORD
    met = reduce(DataFrame.unionByName, (x.join(y, ["g", "n"]) for x, y in ((a.where(long_a), k), (a.where(~long_a), k.where(long_k)))))
    met = met.where(F.least(la, lb) >= bound * F.greatest(la, lb) - 1e-9).groupBy("word", "close").agg(F.count(F.lit(1)).alias("shared"))
    # of m matched letters and both ends, m + 1 pairs of neighbours, less one for each of the a + b - 2m others
    whole = met.where(F.col("shared") >= 3 * F.ceil((la + lb) * (cutoff / 2) - 1e-9) + 1 - (la + lb)).select("word", "close")
    return _at_work(near.unionByName(whole).where("word <> close"), "word").distinct()


def most_ratio(a: int, b: int) -> float:
    """The greatest matching-blocks ratio of two different words of ``a`` and ``b`` letters."""
    return 2.0 * min(a, b, max(a, b) - 1) / (a + b)


def closest_words(words: DataFrame, vocabulary: DataFrame, cutoff: float = 0.78) -> DataFrame:
    """``word``, ``close``: the known word with the best matching-blocks ratio of at least ``cutoff``; the greatest string on ties."""
    pairs = meeting_words(words, vocabulary, cutoff).sortWithinPartitions("word")

    def rate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = difflib.SequenceMatcher()
        for b in batches:
            out = []
            for w, met in itertools.groupby(zip(b["word"], b["close"], strict=True), operator.itemgetter(0)):
                m.set_seq2(w)
                best: tuple[float, str] = (cutoff, "")
                # the likeliest by length first: the others mostly can't be better then
                for most, c in sorted(((most_ratio(len(w), len(c)), c) for _, c in met), reverse=True):
                    if (most, c) < best:
                        break
                    m.set_seq1(c)
                    if len(w) + len(c) <= 2 * SHORT_WORD or m.quick_ratio() >= best[0]:
                        best = max(best, (m.ratio(), c))
                if best[1]:
                    out.append((w, best[1], best[0]))
            yield pd.DataFrame(out, columns=["word", "close", "ratio"])

    rated = pairs.mapInPandas(frames(rate), "word string, close string, ratio double")
    return rated.groupBy("word").agg(F.max_by("close", F.struct("ratio", "close")).alias("close"))


def token_counts(sentences: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``word``, ``n``: content words of each sentence."""
    return sentences.select(key, F.explode(content_tokens(F.col(text))).alias("word")).groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"))


def unknown_word_puns(sentences: DataFrame, vocabulary: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``word``, ``m1``, ``m2``, ``score``: the most suspicious word that the vocabulary lacks.

    Unknown words score by repetition, length, a close known word and a known word
    inside; the best score wins, then the more frequent, then the lesser word.
    """
    vocabulary = checkpointed(vocabulary.select("word").distinct())
    counts = token_counts(sentences, key, text)
    strange = checkpointed(counts.join(vocabulary, "word", "left_anti"))
    extra = strange.select("word").distinct()
    seen = strange.join(closest_words(extra, vocabulary), "word", "left").join(longest_subword(extra, vocabulary), "word", "left")
    meanings = F.array_compact(F.array(F.col("close"), F.when(F.coalesce(F.col("sub") != F.col("close"), F.col("sub").isNotNull()), F.col("sub"))))
    score = (
        F.lit(50.0) + 8.0 * (F.col("n") - 1) + F.least(F.lit(6.0), F.greatest(F.lit(0.0), (F.length("word") - 5).cast("double"))) * 0.8
        + F.when(F.col("close").isNotNull(), 10.0).otherwise(0.0) + F.when(F.col("sub").isNotNull(), 10.0).otherwise(0.0) - F.when(F.size(meanings) < 2, 12.0).otherwise(0.0)
    )
    rated = seen.select(
        key, "word", "n", F.coalesce(F.get(meanings, F.lit(0)), F.col("word")).alias("m1"), F.coalesce(F.get(meanings, F.lit(1)), F.col("close"), F.col("sub"), F.col("word")).alias("m2"), F.round(score, 6).alias("score")
    )
    w = Window.partitionBy(key).orderBy(F.col("score").desc(), F.col("n").desc(), "word")
    return rated.withColumn("r", F.row_number().over(w)).where("r = 1").select(key, "word", "m1", "m2", "score")


def ambiguous_word_puns(sentences: DataFrame, senses: DataFrame, distances: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``word``, ``m1``, ``m2``, ``score``: the word whose two senses lie farthest apart, repetition counting most.

    Of each word the first ten senses are looked at; the first pair with the greatest
    distance is its pair.
    """
    ten = per_key_limit(senses, ["word"], [F.col("ord")], 10)
    many = senses.groupBy("word").agg(F.count(F.lit(1)).alias("n_senses")).where("n_senses > 1")
    a = ten.select("word", F.col("ord").alias("oa"), F.col("sense").alias("s1"), F.col("label").alias("m1"))
    b = ten.select("word", F.col("ord").alias("ob"), F.col("sense").alias("s2"), F.col("label").alias("m2"))
    # ten senses a word at most: 45 pairs
    pairs = a.join(b, "word").where("oa < ob").join(distances, ["s1", "s2"])
    far = pairs.groupBy("word").agg(F.max_by(F.struct("s1", "s2", "m1", "m2", "d"), F.struct("d", -F.col("oa"), -F.col("ob"))).alias("p")).select("word", "p.*")
    named = far.withColumns({"m1": F.when(F.col("m1") == F.col("m2"), F.col("s1")).otherwise(F.col("m1")), "m2": F.when(F.col("m1") == F.col("m2"), F.col("s2")).otherwise(F.col("m2"))})
    counted = token_counts(sentences, key, text).join(named, "word").join(many, "word")
    rated = counted.withColumn("score", F.col("d") + 15 * (F.col("n") - 1) + F.least(F.lit(3.0), 0.25 * F.col("n_senses")))
    w = Window.partitionBy(key).orderBy(F.col("score").desc(), F.col("n").desc(), F.col("d").desc(), "word")
    return rated.withColumn("r", F.row_number().over(w)).where("r = 1").select(key, "word", "m1", "m2", "score")


def detected_puns(sentences: DataFrame, vocabulary: DataFrame, senses: DataFrame, distances: DataFrame, key: str, text: str) -> DataFrame:
    """Unknown words first, ambiguous ones where a sentence has none."""
    first = checkpointed(unknown_word_puns(sentences, vocabulary, key, text))
    rest = sentences.join(first.select(key), key, "left_anti")
    return first.withColumn("kind", F.lit("unknown")).unionByName(ambiguous_word_puns(rest, senses, distances, key, text).withColumn("kind", F.lit("ambiguous")))


def rewritten(sentences: DataFrame, dictionary: DataFrame, key: str, text: str, word: str, pun: str) -> DataFrame:
    """``key``, ``sentence``: word by word, ``word`` replaced by ``pun``, the others by their first translation."""
    parts = sentences.select(key, F.lower(word).alias("__w"), F.col(pun).alias("__p"), F.posexplode(T.words(T.marked_bare(F.lower(text)))).alias("i", "raw"))
    bare = parts.withColumn("bare", F.replace("raw", F.lit(T.MARK), F.lit("")))
    first = sized(dictionary.groupBy(F.lower(F.trim("en")).alias("bare")).agg(F.min_by("fr", "ord").alias("fr")))
    done = bare.join(first, "bare", "left").withColumn("out", F.when(F.col("bare") == F.col("__w"), F.col("__p")).otherwise(F.coalesce("fr", "bare")))
    return done.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "out"))), lambda r: r["out"]), " ").alias("sentence"))
