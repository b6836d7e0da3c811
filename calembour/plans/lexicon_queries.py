"""Queries of the reference operators on vectors, sequences, lexicons, providers and files, with their SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calembour.functions import sequences as S
from calembour.functions import text as T
from calembour.functions import vectors as V
from calembour.operators import lexicon, metrics, providers, relational, vector_search
from calembour.plans import pipelines
from calembour.session import checkpointed, ensure_checkpoint_dir
from calembour.sources import files
from calembour.streaming import stages

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


# ------------------------------------------------------------------ vectors

_UNIT = "WITH u AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), n AS (SELECT vec_id, label, v, sqrt(list_inner_product(v, v)) AS n FROM u)"


@query(_UNIT + """
SELECT a.vec_id AS query, b.vec_id AS neighbour, round(list_inner_product(a.v, b.v) / (a.n * b.n), 6) AS score, CAST(row_number() OVER w AS INT) AS rank
FROM n a JOIN n b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
WINDOW w AS (PARTITION BY a.vec_id ORDER BY round(list_inner_product(a.v, b.v) / (a.n * b.n), 9) DESC, b.vec_id) QUALIFY row_number() OVER w <= 5
""")
def vector_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return vector_search.top_k(e, e.where("vec_id % 50 = 0")).withColumn("score", F.round("score", 6))


@query(_UNIT + "SELECT vec_id, round(list_inner_product(list_transform(v, lambda x: x / n), list_transform(v, lambda x: x / n)), 6) AS norm, round(v[1] * (vec_id % 7) / nullif(n * (vec_id % 7), 0), 6) AS head FROM n".replace("round(v[1] * (vec_id % 7) / nullif(n * (vec_id % 7), 0), 6)", "round(CASE WHEN vec_id % 7 = 0 THEN 0 ELSE v[1] / n END, 6)"))
def l2_normalise(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    scaled = F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") % 7))
    unit = V.normalised(F.col("embedding"))
    return e.select("vec_id", F.round(V.dot(unit, unit), 6).alias("norm"), F.round(F.get(V.normalised(scaled), F.lit(0)), 6).alias("head"))


@query(_UNIT + """,
c AS (SELECT label, i, avg(v[i]) AS x FROM (SELECT label, v, unnest(range(1, 65)) AS i FROM u) GROUP BY label, i),
m AS (SELECT label, list(x ORDER BY i) AS c FROM c GROUP BY label)
SELECT vec_id, round(list_inner_product(v, c) / (n * sqrt(list_inner_product(c, c))), 6) AS similarity, round(greatest(0, least(1, list_inner_product(v, c) / (n * sqrt(list_inner_product(c, c))))), 6) AS clamped
FROM n JOIN m ON n.label = m.label
""")
def centroid_cosine(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    c = metrics.mean_pooled(e, "label", "embedding").withColumnRenamed("embedding", "centroid")
    s = V.cosine(F.col("embedding"), F.col("centroid"))
    return e.join(c, "label").select("vec_id", F.round(s, 6).alias("similarity"), F.round(V.clamped(s), 6).alias("clamped"))


_NEIGHBOURS = _UNIT + ", s AS (SELECT a.vec_id, list_inner_product(a.v, b.v) / (a.n * b.n) AS s FROM n a JOIN n b ON b.vec_id = a.vec_id + 1)"


@query(_NEIGHBOURS + """
SELECT round(avg(s), 6) AS mean, round(var_pop(s), 6) AS variance, count(*) FILTER (s > 0.75) AS n_gt_075, round(count(*) FILTER (s > 0.75) / CAST(count(*) AS DOUBLE), 6) AS share_gt_075,
  count(*) FILTER (s < 0.25) AS n_lt_025, round(count(*) FILTER (s < 0.25) / CAST(count(*) AS DOUBLE), 6) AS share_lt_025, CAST(sum(vec_id % 2) AS BIGINT) AS problems, round(sum(vec_id % 2) / CAST(count(*) AS DOUBLE), 6) AS problem_share FROM s
""")
def similarity_summary(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    s = e.join(nxt, "vec_id").select(V.cosine(F.col("embedding"), F.col("other")).alias("s"), (F.col("vec_id") % 2).alias("odd"))
    out = metrics.similarity_summary(s, "s", "odd")
    return out.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes))


_MEANINGS = ("first_meaning", "second_meaning", "first_meaning_fr", "second_meaning_fr")
_COSINE = "list_inner_product({a}, {b}) / (sqrt(list_inner_product({a}, {a})) * sqrt(list_inner_product({b}, {b})))"
_SIMILARITIES = {c: _COSINE.format(a=f"v_pun_word{c[-3:] if c.endswith('_fr') else ''}", b=f"v_{c}") for c in _MEANINGS}


@query(f"""
WITH w AS (SELECT DISTINCT unnest([pun_word, pun_word_fr, {", ".join(_MEANINGS)}]) AS word FROM translated),
n AS (SELECT word, CAST('0x' || substr(md5(word), 1, 8) AS BIGINT) % (SELECT greatest(count(*), 1) FROM embeddings) AS vec_id FROM w WHERE word IS NOT NULL),
v AS (SELECT word, CAST(embedding AS DOUBLE[]) AS v FROM n JOIN embeddings ON n.vec_id = embeddings.vec_id),
s AS (SELECT rec_id, {", ".join(f"{e} AS {c}" for c, e in _SIMILARITIES.items())} FROM (SELECT rec_id, {", ".join(f"{c}.v AS v_{c}" for c in ("pun_word", "pun_word_fr", *_MEANINGS))} FROM translated t
  {" ".join(f"LEFT JOIN v {c} ON {c}.word = t.{c}" for c in ("pun_word", "pun_word_fr", *_MEANINGS))}))
SELECT rec_id, round(first_meaning, 6) AS first_similarity_en, round(second_meaning, 6) AS second_similarity_en, round(first_meaning_fr, 6) AS first_similarity_fr, round(second_meaning_fr, 6) AS second_similarity_fr,
  round(first_meaning - first_meaning_fr, 6) AS first_difference, round(second_meaning - second_meaning_fr, 6) AS second_difference FROM s
""")
def meaning_similarities(spark, sf_dir):
    """Six similarities of the translated records; words stand for the vectors of their numbers."""
    df = table(spark, sf_dir, "translated")
    v = table(spark, sf_dir, "embeddings")
    parts = ["pun_word", "pun_word_fr", "first_meaning", "second_meaning", "first_meaning_fr", "second_meaning_fr"]
    words = df.select(F.explode(F.array(*parts)).alias("word")).where("word IS NOT NULL").distinct()
    size = v.count()
    named = words.withColumn("vec_id", F.conv(F.substring(F.md5("word"), 1, 8), 16, 10).cast("bigint") % F.lit(max(size, 1))).join(v.select("vec_id", "embedding"), "vec_id").select("word", "embedding")
    lists = df.select("rec_id", "pun_word", "pun_word_fr", *(F.array_compact(F.array(p)).alias(p) for p in parts[2:]))
    out = pipelines.similarity(lists, named)
    return out.select("rec_id", *(F.round(c, 6).alias(c) for c, t in out.dtypes if t == "double"))


# ---------------------------------------------------------------- sequences

@query("""
WITH c AS (SELECT rec_id, list_filter(string_split(lower(pun_word), ''), lambda x: x <> '') AS s FROM translated WHERE pun_word IS NOT NULL)
SELECT rec_id, array_to_string(list_transform(list_concat(s, list_transform(range(0, 30), lambda x: '0'))[1:30], lambda x: CASE WHEN x BETWEEN 'a' AND 'z' THEN CAST(ascii(x) - 96 AS VARCHAR) ELSE '0' END), ',') AS ids FROM c
""")
def padded_ids(spark, sf_dir):
    letters = F.filter(F.split(F.lower("pun_word"), ""), lambda x: x != "")
    ids = F.transform(letters, lambda x: F.when(x.between("a", "z"), F.ascii(x) - 96))
    df = table(spark, sf_dir, "translated").where("pun_word IS NOT NULL")
    return df.select("rec_id", F.array_join(S.padded(ids).cast("array<string>"), ",").alias("ids"))


# A coarse sound description of letters (vowel, open, front, rounded, stop, nasal, fricative, liquid, voiced).
SOUND_NAMES = ["vowel", "open", "front", "round", "stop", "nasal", "fricative", "liquid", "voiced"]
SOUNDS = {
    "a": "++00----+", "e": "+-+-----+", "i": "+-+-----+", "o": "+--+----+", "u": "+--+----+", "y": "+-++----+",
    "b": "----+---+", "d": "----+---+", "g": "----+---+", "p": "----+----", "t": "----+----", "k": "----+----", "c": "----+----", "q": "----+----",
    "m": "-----+--+", "n": "-----+--+", "f": "------+--", "s": "------+--", "x": "------+--", "h": "------+--", "v": "------+-+", "z": "------+-+", "j": "------+-+", "w": "---+--+-+",
    "l": "-------++", "r": "-------++",
}


def _features(letter):
    """The names of a letter's positive features; the boundary marks have one of their own."""
    known = F.create_map(*(F.lit(x) for k, v in SOUNDS.items() for x in (k, "|".join(n for n, s in zip(SOUND_NAMES, v, strict=True) if s == "+"))))
    names = F.split(F.coalesce(F.try_element_at(known, letter), F.lit("")), r"\|")
    return F.when(letter == "BEG", F.array(F.lit("beg"))).when(letter == "END", F.array(F.lit("end"))).otherwise(F.filter(names, lambda x: x != ""))


def bigram_similarity(a, b):
    """Jaccard of the united features of two bigrams, each already an array of names."""
    return S.jaccard(a, b)


def _bigrams(word):
    """The boundary bigrams of a word, each as the united features of its two segments."""
    letters = F.filter(F.split(F.lower(word), ""), lambda x: x != "")
    return F.transform(S.boundary_bigrams(letters), lambda g: F.array_union(_features(g["a"]), _features(g["b"])))


_PAIRS_SQL = "SELECT DISTINCT lower(pun_word) AS a, lower(pun_word_fr) AS b FROM translated WHERE pun_word <> '' AND pun_word_fr <> ''"


def _pairs(spark, sf_dir):
    df = table(spark, sf_dir, "translated").where("pun_word <> '' AND pun_word_fr <> ''")
    return df.select(F.lower("pun_word").alias("a"), F.lower("pun_word_fr").alias("b")).distinct()


@query(f"""
WITH p AS ({_PAIRS_SQL}),
g AS (SELECT a, b, list_distinct(list_transform(range(0, length(a) + 1), lambda i: CASE WHEN i = 0 THEN 'BEG' ELSE a[i] END || CASE WHEN i = length(a) THEN 'END' ELSE a[i + 1] END)) AS ga,
  list_distinct(list_transform(range(0, length(b) + 1), lambda i: CASE WHEN i = 0 THEN 'BEG' ELSE b[i] END || CASE WHEN i = length(b) THEN 'END' ELSE b[i + 1] END)) AS gb FROM p)
SELECT a, b, round(len(list_intersect(ga, gb)) / CAST(len(list_distinct(list_concat(ga, gb))) AS DOUBLE), 6) AS similarity FROM g
""")
def bigram_jaccard(spark, sf_dir):
    def grams(c):
        letters = F.filter(F.split(F.col(c), ""), lambda x: x != "")
        return F.array_distinct(F.transform(S.boundary_bigrams(letters), lambda g: F.concat(g["a"], g["b"])))

    return _pairs(spark, sf_dir).select("a", "b", F.round(S.jaccard(grams("a"), grams("b")), 6).alias("similarity"))


_NAMES = "MAP {" + ", ".join(f"'{k}': {[n for n, m in zip(SOUND_NAMES, v, strict=True) if m == '+']}" for k, v in SOUNDS.items()) + "}"


def _grams_sql(word: str) -> str:
    """SQL of the boundary bigrams of a word as lists of feature names."""
    side = lambda at, edge, mark: f"CASE WHEN i = {edge} THEN ['{mark}'] ELSE coalesce(names[{word}[{at}]], []) END"
    return f"list_transform(range(0, length({word}) + 1), lambda i: list_distinct(list_concat({side('i', '0', 'beg')}, {side('i + 1', f'length({word})', 'end')})))"


@query(f"""
WITH RECURSIVE p AS ({_PAIRS_SQL}),
g AS (SELECT a, b, {_grams_sql("a")} AS ga, {_grams_sql("b")} AS gb FROM (SELECT a, b, {_NAMES} AS names FROM p)),
r AS (SELECT a, b, ga, gb, 0 AS i, list_transform(range(0, len(gb) + 1), lambda x: 0.0::DOUBLE) AS scores FROM g
  UNION ALL SELECT a, b, ga, gb, i + 1, list_concat([0.0::DOUBLE], list_transform(range(1, len(best) + 1), lambda j: list_max(best[1:j]))) FROM (
    SELECT *, list_transform(range(1, len(gb) + 1), lambda j: greatest(scores[j + 1], scores[j] + CASE WHEN len(list_concat(ga[i + 1], gb[j])) = 0 THEN 0
      ELSE len(list_intersect(ga[i + 1], gb[j])) / CAST(len(list_distinct(list_concat(ga[i + 1], gb[j]))) AS DOUBLE) END)) AS best FROM r WHERE i < len(ga)))
SELECT a, b, round(scores[len(scores)] / greatest(len(ga), len(gb)), 6) AS similarity FROM r WHERE i = len(ga)
""")
def weighted_alignment(spark, sf_dir):
    """Order-keeping alignment of the sound features of each English and French pun word."""
    p = _pairs(spark, sf_dir).select("a", "b", _bigrams(F.col("a")).alias("ga"), _bigrams(F.col("b")).alias("gb"))
    return p.select("a", "b", F.round(S.alignment_score(F.col("ga"), F.col("gb"), bigram_similarity), 6).alias("similarity"))


_MARKS = ", ".join(f"('{k}', '{v}')" for k, v in SOUNDS.items())


@query(f"""
WITH s(letter, marks) AS (VALUES {_MARKS}), l AS (SELECT DISTINCT unnest(string_split(lower(pun_word), '')) AS letter FROM translated),
m AS (SELECT l.letter, coalesce(marks, repeat('0', {len(SOUND_NAMES)})) AS marks FROM l LEFT JOIN s ON s.letter = l.letter WHERE l.letter <> '')
SELECT letter, array_to_string(list_transform(string_split(marks, ''), lambda x: CASE x WHEN '+' THEN '1' WHEN '-' THEN '-1' ELSE '0' END), ',') AS signs,
  array_to_string(list_transform(list_filter(range(1, {len(SOUND_NAMES) + 1}), lambda i: marks[i] = '+'), lambda i: {SOUND_NAMES}[i]), ',') AS names FROM m
""")
def sound_vectors(spark, sf_dir):
    """Signs of the sound features of each letter of the pun words."""
    letters = table(spark, sf_dir, "translated").select(F.explode(F.split(F.lower("pun_word"), "")).alias("letter")).where("letter <> ''").distinct()
    known = F.create_map(*(F.lit(x) for k, v in SOUNDS.items() for x in (k, v)))
    marks = F.split(F.coalesce(F.try_element_at(known, F.col("letter")), F.lit("0" * len(SOUND_NAMES))), "")
    return letters.select("letter", F.array_join(S.signs(marks).cast("array<string>"), ",").alias("signs"), F.array_join(S.positive_names(SOUND_NAMES, marks), ",").alias("names"))


# ------------------------------------------------------------------ lexicon

def _lexicon(spark, sf_dir):
    """Words of the French texts with their consonants as sound, in the order of first occurrence."""
    tokens = table(spark, sf_dir, "translation_fr").select("ord", F.posexplode(T.tokens(F.col("text_fr"))).alias("i", "word")).where(F.length("word") >= 3)
    # the first place as one number: aggregates of structs sort all their rows
    wide = F.lit(2**31).cast("decimal(11,0)")
    first = tokens.groupBy("word").agg(F.min(F.col("ord").cast("decimal(20,0)") * wide + F.col("i").cast("decimal(10,0)")).alias("at"))
    sound = F.regexp_replace("word", "[aeiouy']", "")
    at_ord = F.floor(F.col("at") / wide)
    i = F.col("at") - at_ord * wide
    return first.select("word", sound.alias("phon"), (at_ord.cast("bigint") * 1000 + i.cast("bigint")).alias("ord")).where(F.length("phon") >= 2)


_LEXICON = """
WITH t AS (SELECT ord, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM (SELECT ord, regexp_extract_all(lower(text_fr), '[a-z'']+') AS w FROM translation_fr)),
f AS (SELECT word, min((ord, i)) AS pos FROM t WHERE length(word) >= 3 GROUP BY word),
l AS (SELECT word, regexp_replace(word, '[aeiouy'']', '', 'g') AS phon, pos[1] * 1000 + pos[2] AS ord FROM f),
lex AS (SELECT * FROM l WHERE length(phon) >= 2)
"""


_HOMOPHONES = """
SELECT a.word, b.word AS homophone, CAST(row_number() OVER w AS INT) AS rank FROM lex a JOIN lex b ON a.phon = b.phon AND a.word <> b.word
WINDOW w AS (PARTITION BY a.word ORDER BY b.ord, b.word) QUALIFY row_number() OVER w <= 30
"""


@query(_LEXICON + _HOMOPHONES)
def homophones(spark, sf_dir):
    return lexicon.homophones(_lexicon(spark, sf_dir))


@query(_LEXICON + "SELECT phon, string_agg(word, ',' ORDER BY ord, word) AS words FROM lex GROUP BY phon")
def phonetic_index(spark, sf_dir):
    return lexicon.phonetic_index(_lexicon(spark, sf_dir)).select("phon", F.array_join("words", ",").alias("words"))


def _related(spark, sf_dir):
    """French pun words and the words of their meanings, weighted by the number of records."""
    df = table(spark, sf_dir, "translated").where("pun_word_fr <> ''")
    term = F.explode(F.array_distinct(F.concat(T.tokens(F.coalesce("first_meaning_fr", F.lit(""))), T.tokens(F.coalesce("second_meaning_fr", F.lit(""))))))
    pairs = df.select(F.lower("pun_word_fr").alias("word"), term.alias("term"), "rec_id").where(F.length("term") >= 3)
    return pairs.groupBy("word", "term").agg(F.count(F.lit(1)).cast("double").alias("weight"), F.min("rec_id").alias("ord"))


_RELATED = """
WITH d AS (SELECT lower(pun_word_fr) AS word, rec_id, unnest(list_distinct(list_concat(regexp_extract_all(lower(coalesce(first_meaning_fr, '')), '[a-z'']+'), regexp_extract_all(lower(coalesce(second_meaning_fr, '')), '[a-z'']+')))) AS term FROM translated WHERE pun_word_fr <> ''),
r AS (SELECT word, term, CAST(count(*) AS DOUBLE) AS weight FROM d WHERE length(term) >= 3 GROUP BY word, term)
"""


@query(_RELATED + """,
p AS (SELECT DISTINCT term AS a, word AS b FROM r)
SELECT p.a, p.b, round(CASE WHEN p.a = p.b THEN 1 ELSE least(1, greatest(coalesce(x.weight, 0), coalesce(y.weight, 0)) / 10) END, 6) AS score
FROM p LEFT JOIN r x ON x.word = p.a AND x.term = p.b LEFT JOIN r y ON y.word = p.b AND y.term = p.a
""")
def relatedness_score(spark, sf_dir):
    r = _related(spark, sf_dir)
    return lexicon.relatedness(r.select(F.col("term").alias("a"), F.col("word").alias("b")).distinct(), r).withColumn("score", F.round("score", 6))


def _dictionary(spark, sf_dir):
    df = table(spark, sf_dir, "translated").where("pun_word <> '' AND pun_word_fr <> ''")
    return df.groupBy(F.lower(F.trim("pun_word")).alias("en"), F.lower("pun_word_fr").alias("fr")).agg(F.min("rec_id").alias("ord"))


def _seeds(spark, sf_dir):
    """Each translated record's pun word with that of the record before it."""
    df = table(spark, sf_dir, "translated").where("pun_word <> ''").select(F.col("rec_id").alias("id"), F.lower(F.trim("pun_word")).alias("m1"))
    before = df.select((F.col("id") + 1).alias("id"), F.col("m1").alias("m2"))
    return df.join(before, "id")


def shared_translations(dictionary):
    """Words with a French word in common, as synonyms."""
    pairs = dictionary.select("fr", F.col("en").alias("word")).join(dictionary.select("fr", F.col("en").alias("synonym")), "fr")
    return pairs.where("word <> synonym").select("word", "synonym").distinct()


def _strong(least: int, most: int) -> str:
    return f"(SELECT word, term, ord FROM rel WHERE weight > {least} QUALIFY row_number() OVER (PARTITION BY word ORDER BY ord, term) <= {most})"


def _near(most: int) -> str:
    return f"(SELECT * FROM hom WHERE rank <= {most})"


def _first(level: int, chain: str, factor: float) -> str:
    """The first hit of a chain (id, word to compare, pun, o: the order of its steps) whose word is related to a translation of the second meaning."""
    return f"""c{level} AS ({chain}),
s{level} AS (SELECT id, {level} AS level, pun, score * {factor} AS confidence FROM (
  SELECT c.id, c.pun, c.o, t2.o2, CASE WHEN trim(c.word) = '' OR trim(t2.t2) = '' THEN 0 WHEN lower(trim(c.word)) = lower(trim(t2.t2)) THEN 1
    ELSE least(1, greatest(coalesce(x.weight, 0), coalesce(y.weight, 0)) / 10) END AS score
  FROM c{level} c JOIN t2 ON t2.id = c.id LEFT JOIN rel x ON x.word = c.word AND x.term = t2.t2 LEFT JOIN rel y ON y.word = t2.t2 AND y.term = c.word)
  WHERE score >= 0.25 QUALIFY row_number() OVER (PARTITION BY id ORDER BY o, o2, pun, score) = 1)"""


def _open(level: int, source: str = "t1") -> str:
    return f"(SELECT * FROM {source} WHERE " + " AND ".join(f"id NOT IN (SELECT id FROM s{k})" for k in range(4, level)) + ")"


def _best(level: int, most: int) -> str:
    return f"(SELECT * FROM {_open(level)} QUALIFY row_number() OVER (PARTITION BY id ORDER BY o1) <= {most})"


_CASCADE = f"""{_LEXICON},
hom AS ({_HOMOPHONES}),
d AS (SELECT lower(pun_word_fr) AS word, rec_id, unnest(list_distinct(list_concat(regexp_extract_all(lower(coalesce(first_meaning_fr, '')), '[a-z'']+'), regexp_extract_all(lower(coalesce(second_meaning_fr, '')), '[a-z'']+')))) AS term FROM translated WHERE pun_word_fr <> ''),
rel AS (SELECT word, term, CAST(count(*) AS DOUBLE) AS weight, min(rec_id) AS ord FROM d WHERE length(term) >= 3 GROUP BY word, term),
dic AS (SELECT lower(trim(pun_word)) AS en, lower(pun_word_fr) AS fr, min(rec_id) AS ord FROM translated WHERE pun_word <> '' AND pun_word_fr <> '' GROUP BY 1, 2),
syn AS (SELECT DISTINCT a.en AS word, b.en AS synonym FROM dic a JOIN dic b ON a.fr = b.fr WHERE a.en <> b.en),
one AS (SELECT rec_id AS id, lower(trim(pun_word)) AS m FROM translated WHERE pun_word <> ''),
seed AS (SELECT a.id, a.m AS m1, b.m AS m2 FROM one a JOIN one b ON b.id = a.id - 1),
t1 AS (SELECT id, m1, coalesce(fr, m1) AS t1, coalesce(ord, 0) AS o1 FROM seed LEFT JOIN dic ON en = m1),
t2 AS (SELECT id, coalesce(fr, m2) AS t2, coalesce(ord, 0) AS o2 FROM seed LEFT JOIN dic ON en = m2),
s4 AS (SELECT t1.id, 4 AS level, t1.t1 AS pun, 1.0 AS confidence FROM t1 JOIN t2 ON t1.id = t2.id AND t1.t1 = t2.t2 QUALIFY row_number() OVER (PARTITION BY t1.id ORDER BY o1, o2, t1.t1) = 1),
{_first(5, f"SELECT id, homophone AS word, homophone AS pun, [o1, rank] AS o FROM {_open(5)} t JOIN hom ON t.t1 = hom.word", 1.0)},
base AS (SELECT DISTINCT id, m1 AS word FROM {_open(6)}),
every AS (SELECT id, word AS syn, 0 AS kind FROM base UNION ALL SELECT id, synonym, 1 FROM base JOIN syn USING (word)),
kept AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY id ORDER BY kind, syn) <= 12),
told AS (SELECT id, kind, syn, coalesce(fr, syn) AS fr, coalesce(ord, 0) AS ord FROM kept LEFT JOIN dic ON en = lower(trim(syn))),
{_first(6, "SELECT id, homophone AS word, homophone AS pun, (kind, syn, told.ord, rank) AS o FROM told JOIN hom ON told.fr = hom.word", 1.0)},
{_first(7, f"SELECT id, b.term AS word, h.homophone AS pun, [o1, a.ord, h.rank, b.ord] AS o FROM {_best(7, 3)} t JOIN {_strong(3, 10)} a ON a.word = t.t1 JOIN {_near(10)} h ON h.word = a.term JOIN {_strong(3, 10)} b ON b.word = h.homophone", 0.8)},
{_first(8, f"SELECT id, g.homophone AS word, g.homophone AS pun, [o1, a.ord, h.rank, b.ord, g.rank] AS o FROM {_best(8, 2)} t JOIN {_strong(4, 5)} a ON a.word = t.t1 JOIN {_near(5)} h ON h.word = a.term JOIN {_strong(4, 5)} b ON b.word = h.homophone JOIN {_near(5)} g ON g.word = b.term", 0.6)},
hit AS ({" UNION ALL ".join(f"SELECT * FROM s{k}" for k in range(4, 9))}),
literal AS (SELECT id, min_by(t1, o1) AS literal FROM t1 GROUP BY id)
SELECT literal.id, CAST(level AS INT) AS level, pun, round(confidence, 6) AS confidence, CASE WHEN level IS NULL THEN literal END AS fallback FROM literal LEFT JOIN hit ON hit.id = literal.id
"""


@query(_CASCADE)
def polygon_cascade(spark, sf_dir):
    d = _dictionary(spark, sf_dir)
    return lexicon.polygons(_seeds(spark, sf_dir), d, _lexicon(spark, sf_dir), _related(spark, sf_dir), shared_translations(d)).withColumn("confidence", F.round("confidence", 6))


def _vocabulary(spark, sf_dir):
    """Words that at least three jokes share."""
    counts = table(spark, sf_dir, "cleaned_en").select("ord", F.explode(F.array_distinct(T.tokens(F.col("text_clean")))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where("n >= 3").select("word")


def _sentences(spark, sf_dir):
    return table(spark, sf_dir, "cleaned_en").select("ord", "text_clean")


@query("""
WITH w AS (SELECT ord, unnest(list_distinct(regexp_extract_all(lower(text_clean), '[a-z'']+'))) AS word FROM cleaned_en),
v AS (SELECT word FROM w GROUP BY word HAVING count(*) >= 3), x AS (SELECT DISTINCT word FROM w WHERE word NOT IN (SELECT word FROM v) AND length(word) >= 4),
s AS (SELECT word, i, n, substr(word, i, n) AS sub FROM (SELECT word, i, unnest(range(4, length(word) - i + 2)) AS n FROM (SELECT word, unnest(range(1, length(word) - 2)) AS i FROM x)))
SELECT word, sub FROM s WHERE sub IN (SELECT word FROM v) QUALIFY row_number() OVER (PARTITION BY word ORDER BY n DESC, i) = 1
""")
def subword_match(spark, sf_dir):
    known = _vocabulary(spark, sf_dir)
    words = _sentences(spark, sf_dir).select(F.explode(T.tokens(F.col("text_clean"))).alias("word")).distinct().join(known, "word", "left_anti")
    return lexicon.longest_subword(words, known)


@query()
def closest_word(spark, sf_dir):
    known = _vocabulary(spark, sf_dir)
    words = _sentences(spark, sf_dir).select(F.explode(T.tokens(F.col("text_clean"))).alias("word")).distinct().join(known, "word", "left_anti")
    return lexicon.closest_words(words, known)


def sense_distances(spark, sf_dir):
    """The first ten senses of each pun word (the meanings noted for it), and how far the senses of a word are apart."""
    noted = table(spark, sf_dir, "translated").select(F.lower("pun_word").alias("word"), "rec_id", F.explode(F.array("first_meaning", "second_meaning")).alias("label")).where("label <> ''")
    senses = noted.groupBy("word", "label").agg(F.min("rec_id").alias("ord")).withColumn("sense", F.concat_ws(".", "word", "label"))
    ten = checkpointed(relational.per_key_limit(senses, ["word"], [F.col("ord"), F.col("label")], 10))
    a, b = ten.select("word", F.col("sense").alias("s1"), F.col("label").alias("l1")), ten.select("word", F.col("sense").alias("s2"), F.col("label").alias("l2"))
    return ten, a.join(b, "word").where("s1 <> s2").select("s1", "s2", F.levenshtein("l1", "l2").alias("d"))


@query()
def detected_puns(spark, sf_dir):
    """Unknown words first; else the word with the two senses farthest apart."""
    return lexicon.detected_puns(_sentences(spark, sf_dir), _vocabulary(spark, sf_dir), *sense_distances(spark, sf_dir), "ord", "text_clean")


@query("""
WITH w AS (SELECT rec_id, lower(pun_word) AS pw, pun_word_fr AS p, list_filter(regexp_split_to_array(text_clean, '\\s+'), lambda x: x <> '') AS w FROM translated WHERE text_clean IS NOT NULL AND pun_word IS NOT NULL AND pun_word_fr IS NOT NULL),
b AS (SELECT rec_id, pw, p, i, regexp_replace(lower(w[i]), '[^\\p{L}\\p{N}_'']', '', 'g') AS bare FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM w)),
d AS (SELECT lower(trim(pun_word)) AS en, min_by(lower(pun_word_fr), rec_id) AS fr FROM translated WHERE pun_word <> '' AND pun_word_fr <> '' GROUP BY 1)
SELECT rec_id, string_agg(CASE WHEN bare = pw THEN p ELSE coalesce(fr, bare) END, ' ' ORDER BY i) AS sentence FROM b LEFT JOIN d ON bare = en GROUP BY rec_id
""")
def sentence_rewrite(spark, sf_dir):
    df = table(spark, sf_dir, "translated").where("text_clean IS NOT NULL AND pun_word IS NOT NULL AND pun_word_fr IS NOT NULL")
    return lexicon.rewritten(df, _dictionary(spark, sf_dir), "rec_id", "text_clean", "pun_word", "pun_word_fr")


# ---------------------------------------------------------------- providers

@query("SELECT pair_id, lower(trim(pun_word)) AS pun_word, CASE WHEN pun_word IS NULL THEN 'no response' WHEN pair_id % 5 = 0 THEN 'no JSON object' END AS error FROM generated_puns WHERE pair_id % 5 <> 0 OR TRUE".replace("lower(trim(pun_word)) AS pun_word", "CASE WHEN pair_id % 5 <> 0 THEN pun_word END AS pun_word"))
def recorded_provider(spark, sf_dir):
    """Recorded answers are parsed by field name; every fifth one trails off behind its JSON."""
    g = table(spark, sf_dir, "generated_puns").select("pair_id", "pun_word", F.concat_ws(" ", F.lit("question"), F.col("pair_id").cast("string")).alias("prompt"))
    tail = F.when(F.col("pair_id") % 5 == 0, F.lit(' and also {"more": ')).otherwise(F.lit(" I hope this helps."))
    answers = g.select("prompt", F.when(F.col("pun_word").isNotNull(), F.concat(F.lit("Here: "), F.to_json(F.struct(F.lit("x").alias("extra"), "pun_word")), tail, F.when(F.col("pair_id") % 5 == 0, F.lit("}}")).otherwise(F.lit("")))).alias("response"))
    asked = providers.ask(g.select("pair_id", "prompt"), "prompt", None, answers)
    return providers.parsed(asked, "pun_word string").select("pair_id", "pun_word", "error")


@query("SELECT rec_id, CAST(i AS INT) AS iteration, i = 1 + rec_id % 3 AS stop FROM (SELECT rec_id, unnest(range(1, 2 + rec_id % 3)) AS i FROM translated WHERE text_clean IS NOT NULL)")
def rewriting_loop(spark, sf_dir):
    df = table(spark, sf_dir, "translated").where("text_clean IS NOT NULL").select("rec_id", F.concat((F.col("rec_id") % 3).cast("string"), F.lit("|"), "text_clean").alias("t"))
    return providers.loop(df, "rec_id", "t", _step, 10).select("rec_id", "iteration", "stop")


def _step(text: str, iteration: int) -> tuple[str, bool]:
    return text, iteration > int(text.partition("|")[0])


# -------------------------------------------------------------------- files

def _folder(spark: SparkSession, name: str) -> str:
    """A fresh folder beside the checkpoints, which all executors share."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT rec_id, coalesce(pun_word, '') AS pun_word, coalesce(text_clean, '') AS text_clean FROM translated")
def csv_round_trip(spark, sf_dir):
    path = _folder(spark, "csv") + ".csv"
    files.save(table(spark, sf_dir, "translated").select("rec_id", "pun_word", "text_clean"), path)
    return files.load(spark, path, "rec_id bigint, pun_word string, text_clean string")


@query("SELECT event_id, event_type, value FROM events")
def json_round_trip(spark, sf_dir):
    path = _folder(spark, "json") + ".json"
    files.save(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), path)
    return spark.read.schema("event_id bigint, event_type string, value double").json(path)


@query("SELECT rec_id, pun_word, chunk_id FROM translated WHERE chunk_id IS NOT NULL")
def chunk_stage(spark, sf_dir):
    """Written per model and chunk, one chunk written again, and read back."""
    folder = _folder(spark, "chunks")
    df = table(spark, sf_dir, "translated").where("chunk_id IS NOT NULL").select("rec_id", "pun_word", "chunk_id")
    files.save_chunks(df, folder, "m")
    files.save_chunks(df.where("chunk_id = 1"), folder, "m")
    return spark.read.parquet(folder).select("rec_id", "pun_word", F.col("chunk_id").cast("int").alias("chunk_id"))


@query("SELECT ord, upper(translator) AS translator FROM translation_fr")
def incremental_stage(spark, sf_dir):
    """A stage run twice over the same files: the second run finds nothing new."""
    source, target, progress = _folder(spark, "in"), _folder(spark, "out"), _folder(spark, "progress")
    df = table(spark, sf_dir, "translation_fr").select("ord", "translator")
    df.write.parquet(source)
    for _ in range(2):
        stages.run_stage(spark, source, "ord bigint, translator string", _shout, target, progress)
    return spark.read.parquet(target).select("ord", "translator")


def _shout(batch: DataFrame) -> DataFrame:
    return batch.withColumn("translator", F.upper("translator"))


@query("SELECT pair_id, model FROM generated_puns")
def resumed_stage(spark, sf_dir):
    """Half the rows done before, the other half now, both in the result."""
    folder = _folder(spark, "resume") + ".parquet"
    df = table(spark, sf_dir, "generated_puns").select("pair_id", "model")
    files.append_rows(df.where("pair_id % 2 = 0"), folder)
    todo, _ = files.resume(spark, df, folder, "pair_id", "pair_id bigint, model string")
    files.append_rows(todo, folder)
    return spark.read.parquet(folder)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


