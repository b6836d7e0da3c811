"""Queries of composite reference operators: lookups, pairing, file formats, refinement, whole translations."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calembour.functions import text as T
from calembour.operators import panel, phonetic, providers, relational, vector_search
from calembour.plans import lexicon_queries, pipelines
from calembour.session import checkpointed, ensure_checkpoint_dir
from calembour.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}-{name}"


@query("""
WITH d AS (SELECT lower(trim(pun_word)) AS word, max_by(pun_word_fr, rec_id) AS fr FROM translated WHERE trim(pun_word) <> '' AND pun_word_fr IS NOT NULL GROUP BY 1)
SELECT pair_id, CASE WHEN trim(coalesce(pun_word, '')) = '' THEN pun_word ELSE coalesce(fr, pun_word) END AS translation, fr IS NOT NULL AS known FROM generated_puns LEFT JOIN d ON d.word = lower(trim(pun_word))
""")
def cached_translation(spark, sf_dir):
    """The last entry of a word wins; unknown and blank words come back as they are."""
    entries = table(spark, sf_dir, "translated").where("trim(pun_word) <> '' AND pun_word_fr IS NOT NULL").select(F.lower(F.trim("pun_word")).alias("word"), "pun_word_fr", "rec_id")
    cache = relational.last_per_key(entries, "word", "pun_word_fr", "rec_id")
    wanted = table(spark, sf_dir, "generated_puns").select("pair_id", "pun_word", F.lower(F.trim("pun_word")).alias("word"))
    hits, _ = files.cached_lookup(wanted, cache, "word")
    return wanted.join(hits, "word", "left").select("pair_id", F.coalesce("pun_word_fr", "pun_word").alias("translation"), F.col("pun_word_fr").isNotNull().alias("known"))


@query("""
WITH a AS (SELECT ord, row_number() OVER (ORDER BY (ord * 7919) % 10007, ord) AS i FROM cleaned_en), b AS (SELECT rec_id, row_number() OVER (ORDER BY (rec_id * 7919) % 10007, rec_id) AS i FROM translated)
SELECT ord, rec_id FROM a JOIN b ON a.i = b.i
""")
def random_pairs(spark, sf_dir):
    return relational.random_pairs(table(spark, sf_dir, "cleaned_en").select("ord"), table(spark, sf_dir, "translated").select("rec_id"), "ord", "rec_id")


@query("SELECT ord, position FROM (SELECT ord, row_number() OVER (ORDER BY ord) - 1 AS position FROM cleaned_en) WHERE position < 474 OR position BETWEEN 475 AND 498")
def positional_slices(spark, sf_dir):
    """The training rows and the rows to predict; the row between them is in neither slice."""
    return relational.sliced(table(spark, sf_dir, "cleaned_en").select("ord"), ["ord"], [(0, 474), (475, 499)]).select("ord", "position")


@query(lexicon_queries.SQL["vector_topk"])
def index_round_trip(spark, sf_dir):
    """An index of unit vectors is written, read back and searched."""
    folder = _folder(spark, "index")
    vector_search.save_index(table(spark, sf_dir, "embeddings"), folder)
    e = vector_search.load_index(spark, folder)
    return vector_search.top_k(e, e.where("vec_id % 50 = 0"), unit=False).withColumn("score", F.round("score", 6))


@query("""
WITH w AS (SELECT unnest(regexp_extract_all(lower(text_fr), '[a-z\'\']+')) AS word FROM translation_fr)
SELECT word, regexp_replace(word, '[aeiouy\'\']', '', 'g') AS phon FROM w WHERE regexp_replace(word, '[aeiouy\'\']', '', 'g') <> '' GROUP BY word
""")
def lexicon_file(spark, sf_dir):
    """A lexicon under other column names is written as TSV and found by its headings; words without a sound are left out."""
    folder = _folder(spark, "lexicon.tsv")
    words = table(spark, sf_dir, "translation_fr").select(F.explode(T.tokens(F.col("text_fr"))).alias("w")).distinct()
    words.select(F.col("w").alias("Ortho"), F.lit("x").alias("extra"), F.regexp_replace("w", "[aeiouy']", "").alias("IPA")).write.option("header", "true").option("sep", "\t").csv(folder)
    return files.load_lexicon(spark, folder).select("word", "phon")


@query("SELECT doc_id, lang AS \"meta.lang\", n_chars AS \"meta.size.chars\" FROM documents")
def flat_json(spark, sf_dir):
    """Nested objects of a JSON file become dotted columns."""
    folder = _folder(spark, "nested.json")
    nested = F.struct("lang", F.struct(F.col("n_chars").alias("chars")).alias("size"))
    table(spark, sf_dir, "documents").select("doc_id", nested.alias("meta")).write.option("ignoreNullFields", "false").json(folder)
    return files.load_flat_json(spark, folder, "doc_id bigint, meta struct<lang:string,size:struct<chars:bigint>>")


@query("""
SELECT pair_id, CAST(greatest(1, 3 - pair_id % 4) AS INT) AS iteration, (least(2, pair_id % 4 + greatest(1, 3 - pair_id % 4) - 1) + 6) / 4.0 AS best_score, TRUE AS accepted,
  CAST(pair_id % 4 + greatest(1, 3 - pair_id % 4) - 1 AS INT) AS marks FROM generated_puns
""")
def refined_translations(spark, sf_dir):
    """A panel rates and a model rewrites: each rewriting adds a mark, and two marks are enough."""
    df = table(spark, sf_dir, "generated_puns").select("pair_id", F.coalesce("text_clean", F.lit("")).alias("source"), F.repeat(F.lit("!"), (F.col("pair_id") % 4).cast("int")).alias("pun"))
    trace = pipelines.refine(df, providers.Stub(_panel), "pair_id", "source", "pun")
    best = panel.best_iteration(trace, "pair_id")
    texts = trace.select("pair_id", "iteration", F.length("text").alias("marks")).distinct()
    return best.join(texts, ["pair_id", "iteration"])


def _panel(prompt: str) -> str:
    if prompt.startswith("Improve"):
        return prompt.partition("\nCurrent: ")[2].partition("\n")[0] + "!"
    marks = prompt.rpartition("\nPun: ")[2].partition("\n")[0].count("!")
    name = prompt.removeprefix("Rate the ").partition(" ")[0]
    return f"Rating: {min(2, marks) if name == 'equivalence' else panel.THRESHOLDS[name]}\nJustification: {marks} marks"


@query()
def sound_neighbours(spark, sf_dir):
    """The five words that sound most like every fiftieth word of the French texts, by trained sound vectors."""
    words = lexicon_queries._lexicon(spark, sf_dir).select("word")
    placed = phonetic.embedded(relational.numbered(words, ["word"], "vec_id"), phonetic.fit(words, lexicon_queries.SOUNDS))
    e = checkpointed(placed.select("vec_id", "word", "embedding"))
    found = vector_search.top_k(e, e.where("vec_id % 50 = 0"))
    names = e.select("vec_id", "word")
    named = found.join(names.withColumnsRenamed({"vec_id": "query"}), "query").join(names.withColumnsRenamed({"vec_id": "neighbour", "word": "similar"}), "neighbour")
    return named.select("word", "similar", F.round("score", 6).alias("score"), "rank")


@query()
def translated_puns(spark, sf_dir):
    """Detection, cascade and rewriting of every joke, word by word where there is no pun."""
    q = lexicon_queries
    senses, far = q.sense_distances(spark, sf_dir)
    dictionary = checkpointed(q._dictionary(spark, sf_dir))
    synonyms = q.shared_translations(dictionary)
    return pipelines.translate_puns(q._sentences(spark, sf_dir), "ord", "text_clean", q._vocabulary(spark, sf_dir), senses, far, dictionary, checkpointed(q._lexicon(spark, sf_dir)), q._related(spark, sf_dir), synonyms)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
