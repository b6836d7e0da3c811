"""Queries of the reference operators on text, lists and relations, over whole tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calembour.functions import text as T
from calembour.functions.vectors import joined_lists
from calembour.operators import metrics, panel, relational
from calembour.plans import pipelines

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


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _replaced(column: str, pairs) -> str:
    for a, b in pairs:
        column = f"replace({column}, {lit(a)}, {lit(b)})"
    return column


def _inverted(cur: str, orig: str) -> str:
    for a, b in T.INVERSIONS:
        cur = f"CASE WHEN contains({orig}, {lit(a)}) THEN replace({cur}, {lit(a)}, {lit(b)}) ELSE {cur} END"
    return cur


_UP = "(x = upper(x) AND x <> lower(x))"
_CLEAN_SQL = f"""
WITH f AS (SELECT id_en, coalesce(en, '') AS t FROM translation_en QUALIFY row_number() OVER (PARTITION BY id_en ORDER BY ord) = 1),
a AS (SELECT id_en, {_replaced("t", T.LITERALS)} AS t FROM f),
b AS (SELECT id_en, CASE WHEN starts_with(t, '- ') THEN substr(t, 3) ELSE t END AS t FROM a),
c AS (SELECT id_en, {_replaced("t", [(d, "") for d in T.DELETED])} AS t FROM b),
w AS (SELECT id_en, list_filter(regexp_split_to_array(t, {lit(T.BLANK + "+")}), lambda x: x <> '') AS w FROM c),
k AS (SELECT id_en, w, coalesce(list_position(list_transform(w, lambda x, i: i > 1 AND length(x) > 2 AND NOT {_UP}), true), 0) AS stop FROM w),
l AS (SELECT id_en, array_to_string(CASE WHEN w[1] = 'OLD' THEN list_transform(w, lambda x, i: CASE WHEN i = 1 THEN 'Old' WHEN length(x) > 2 AND (stop = 0 OR i < stop) THEN lower(x) ELSE x END) ELSE w END, ' ') AS t FROM k),
d AS (SELECT id_en, {_inverted("t", "t")} AS t FROM l),
e AS (SELECT id_en, CASE WHEN contains(t, ', Tom') THEN '"' || replace(t, ', Tom', '," Tom') ELSE t END AS t FROM d),
g AS (SELECT id_en, CASE WHEN contains(t, '! Tom') THEN '"' || replace(t, '! Tom', '!" Tom') ELSE t END AS t FROM e),
h AS (SELECT id_en, CASE WHEN contains(t, '? Tom') THEN '"' || replace(t, '? Tom', '?" Tom') ELSE t END AS t FROM g),
p AS (SELECT id_en, string_split(replace(replace(t, 'Tom''s', 'his'), 'Tom', 'he'), ' -- ') AS p FROM h)
SELECT id_en, array_to_string(list_transform(p, lambda x, i: CASE WHEN i = 1 THEN x WHEN regexp_matches(x, '^[\\p{{L}}\\p{{N}}_]') THEN '. ' || upper(x[1]) || substr(x, 2) ELSE ' -- ' || x END), '') AS text_clean
FROM p
"""


@query(_CLEAN_SQL)
def clean_text(spark, sf_dir):
    return pipelines.clean_en(table(spark, sf_dir, "translation_en"))


@query("SELECT ord, id_en, en FROM translation_en QUALIFY row_number() OVER (PARTITION BY id_en ORDER BY ord) = 1")
def first_per_key(spark, sf_dir):
    return relational.first_per_key(table(spark, sf_dir, "translation_en").select("ord", "id_en", "en"), "id_en", "ord")


@query("SELECT ord, CASE WHEN contains(en, ' -- ') THEN 1 ELSE 0 END AS dashed, CAST(length(en) AS INT) AS n FROM translation_en WHERE length(coalesce(en, '')) > 0")
def non_empty_texts(spark, sf_dir):
    df = table(spark, sf_dir, "translation_en").where(F.length(F.coalesce("en", F.lit(""))) > 0)
    return df.select("ord", F.when(F.col("en").contains(" -- "), 1).otherwise(0).alias("dashed"), F.length("en").alias("n"))


_LABELS = "SELECT doc_id, min(kind) AS kind FROM doc_labels GROUP BY doc_id"


def _labels(spark, sf_dir):
    return table(spark, sf_dir, "doc_labels").groupBy("doc_id").agg(F.min("kind").alias("kind"))


@query(f"SELECT d.doc_id, d.lang, l.kind FROM documents d LEFT JOIN ({_LABELS}) l ON d.doc_id = l.doc_id")
def attach_labels(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(_labels(spark, sf_dir), "doc_id", "left")


@query("""
WITH e AS (
  SELECT t.id_en, t.text_fr, t.ord, i.id, q.location FROM translation_fr t
  LEFT JOIN location_fr_input i ON t.text_fr = i.text AND trim(i.text) <> '' LEFT JOIN location_fr_qrels q ON i.id = q.id)
SELECT id_en, array_to_string(list(text_fr ORDER BY ord, id NULLS FIRST, location NULLS FIRST) FILTER (text_fr IS NOT NULL), '|') AS text_fr,
  array_to_string(list(id ORDER BY ord, id NULLS FIRST, location NULLS FIRST) FILTER (id IS NOT NULL), '|') AS id,
  array_to_string(list(location ORDER BY ord, id NULLS FIRST, location NULLS FIRST) FILTER (location IS NOT NULL), '|') AS location
FROM e GROUP BY id_en
""".replace("AS text_fr,", "AS text_fr,").replace("array_to_string(list(", "array_to_string(list("))
def chained_left_list(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    out = pipelines.combine_fr(t("translation_fr"), t("location_fr_input"), t("location_fr_qrels"))
    joined = lambda c: F.when(F.size(c) > 0, F.array_join(c, "|")).alias(c)
    return out.select("id_en", joined("text_fr"), joined("id"), joined("location"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM doc_labels)")
def skip_done(spark, sf_dir):
    return relational.not_done(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "doc_labels"), "doc_id")


@query("""
WITH a AS (SELECT ord, text_clean, row_number() OVER (ORDER BY ord) - 1 AS position FROM cleaned_en),
b AS (SELECT pair_id, pun_word, row_number() OVER (ORDER BY pair_id) - 1 AS position FROM generated_puns)
SELECT coalesce(a.position, b.position) AS position, ord, text_clean, pair_id, pun_word FROM a FULL JOIN b ON a.position = b.position
""")
def positional_zip(spark, sf_dir):
    return relational.positional_zip(table(spark, sf_dir, "cleaned_en").select("ord", "text_clean"), table(spark, sf_dir, "generated_puns").select("pair_id", "pun_word"), ["ord"], ["pair_id"])


@query("""
SELECT pair_id AS row, generated_pun AS text_clean, 1 AS target FROM generated_puns
UNION ALL SELECT pair_id, text_clean, 0 FROM generated_puns
""")
def contrastive_union(spark, sf_dir):
    g = table(spark, sf_dir, "generated_puns").select(F.col("pair_id").alias("row"), "text_clean", "generated_pun")
    return pipelines.contrastive_set(g.select("row", F.col("generated_pun").alias("text_clean")), g.select("row", F.col("text_clean").alias("non_pun")))


@query(f"SELECT kind, avg(length(text)) AS mean_length, count(*) AS n FROM documents d JOIN ({_LABELS}) l ON d.doc_id = l.doc_id GROUP BY kind")
def mean_length_by_target(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text").join(_labels(spark, sf_dir), "doc_id")
    return pipelines.length_by_target(d, "text", "kind")


@query("SELECT coalesce(translator, '') AS translator, count(*) AS n, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share FROM translation_fr GROUP BY coalesce(translator, '')")
def share_counts(spark, sf_dir):
    return relational.shares(table(spark, sf_dir, "translation_fr"), "translator")


_TYPES = """
WITH t AS (SELECT id_en, lower(pun_type) AS y FROM translated WHERE id_en IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id_en ORDER BY rec_id) = 1),
p AS (SELECT y, trim(lower(coalesce(pun_type, ''))) AS p FROM t JOIN generated_puns g ON t.id_en = g.id_en)
"""


def _types(spark, sf_dir):
    t = relational.first_per_key(table(spark, sf_dir, "translated").where("id_en IS NOT NULL").select("id_en", "rec_id", F.lower("pun_type").alias("y")), "id_en", "rec_id")
    g = table(spark, sf_dir, "generated_puns").select("id_en", F.trim(F.lower(F.coalesce("pun_type", F.lit("")))).alias("p"))
    return t.join(g, "id_en").select("y", "p")


@query(_TYPES + "SELECT round(CAST(avg(CASE WHEN coalesce(y, '') = p THEN 1 ELSE 0 END) AS DOUBLE), 9) AS accuracy, count(*) AS n FROM p")
def accuracy(spark, sf_dir):
    return metrics.accuracy(_types(spark, sf_dir), "y", "p").withColumn("accuracy", F.round("accuracy", 9))


@query(_TYPES + """,
q AS (SELECT coalesce(y, '') AS y, p FROM p), lab AS (SELECT y AS l FROM q UNION SELECT p FROM q),
st AS (SELECT l, sum(CASE WHEN y = l AND p = l THEN 1 ELSE 0 END) tp, sum(CASE WHEN y = l THEN 1 ELSE 0 END) sup, sum(CASE WHEN p = l THEN 1 ELSE 0 END) pr FROM lab, q GROUP BY l)
SELECT round(sum(CASE WHEN pr > 0 THEN CAST(tp AS DOUBLE) / pr * sup END) / nullif(sum(CASE WHEN pr > 0 THEN sup END), 0), 9) AS precision,
  round(CAST(sum(tp) AS DOUBLE) / nullif(sum(sup), 0), 9) AS recall, round(sum(2 * CAST(tp AS DOUBLE) / (sup + pr) * sup) / nullif(sum(sup), 0), 9) AS f1 FROM st
""")
def weighted_scores(spark, sf_dir):
    out = metrics.weighted_scores(_types(spark, sf_dir), "y", "p")
    return out.select(*(F.round(c, 9).alias(c) for c in out.columns))


@query(f"""
SELECT kind, doc_id FROM (SELECT l.kind, d.doc_id FROM documents d JOIN ({_LABELS}) l ON d.doc_id = l.doc_id)
QUALIFY row_number() OVER (PARTITION BY kind ORDER BY (doc_id * 7919) % 10007, doc_id) <= 25
""")
def stratified_few_shot(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id").join(_labels(spark, sf_dir), "doc_id")
    return relational.stratified(d, "kind", "doc_id", 25).select("kind", "doc_id")


@query(f"""
WITH d AS (SELECT CASE WHEN l.kind = 'prose' THEN 1 ELSE 0 END AS target, d.doc_id, d.source FROM documents d JOIN ({_LABELS}) l ON d.doc_id = l.doc_id),
s AS (SELECT *, (doc_id * 7919) % 10007 AS o FROM d QUALIFY row_number() OVER (PARTITION BY target ORDER BY (doc_id * 7919) % 10007, doc_id) <= 25)
SELECT string_agg(CASE WHEN target = 1 THEN 'Contains a pun: ' ELSE 'Does not contain a pun: ' END || source, chr(10) ORDER BY target DESC, o, doc_id) AS context FROM s
""")
def context_block(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(_labels(spark, sf_dir), "doc_id")
    return pipelines.few_shot_context(d.select("doc_id", "source", F.when(F.col("kind") == "prose", 1).otherwise(0).alias("target")), "source", "target", "doc_id")


@query("SELECT rec_id, CAST(rec_id // 100 AS INT) AS chunk_id FROM translated WHERE rec_id // 100 BETWEEN 2 AND 4")
def chunk_range(spark, sf_dir):
    return relational.chunked(table(spark, sf_dir, "translated").select("rec_id"), "rec_id", 100, 2, 4)


@query("""
SELECT rec_id, CAST(n_a + n_b + 1 AS INT) AS n, mean_similarity, problems FROM (
  SELECT rec_id, coalesce(len(first_context), 0) AS n_a, coalesce(len(second_context), 0) AS n_b,
    CASE WHEN coalesce(len(first_context), 0) > coalesce(len(second_context), 0) THEN 1 ELSE 0 END AS problems,
    list_avg(list_transform(range(1, 1 + least(coalesce(len(first_context), 0), coalesce(len(second_context), 0))), lambda i: CASE WHEN first_context[i] IS NOT DISTINCT FROM second_context[i] THEN 1.0 ELSE 0.0 END)) AS mean_similarity
  FROM translated)
""")
def aligned_list_compare(spark, sf_dir):
    df = table(spark, sf_dir, "translated")
    out = pipelines.compared_lists(df, "rec_id", "first_context", "second_context")
    empty = F.array().cast("array<string>")
    n = df.select("rec_id", F.size(joined_lists(F.coalesce("pun_word", F.lit("")), F.coalesce("first_context", empty), F.coalesce("second_context", empty))).alias("n"))
    return out.join(n, "rec_id").select("rec_id", "n", "mean_similarity", "problems")


@query("SELECT rec_id, array_to_string(first_context, '|') AS items, CAST(len(first_context) AS INT) AS n FROM translated WHERE len(first_context) > 0")
def list_literal_parse(spark, sf_dir):
    df = table(spark, sf_dir, "translated").where(F.size("first_context") > 0)
    quoted = F.transform("first_context", lambda x: F.concat(F.lit("'"), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'")))
    text = F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))
    return df.select("rec_id", T.list_literal(text).alias("v")).select("rec_id", F.array_join("v", "|").alias("items"), F.size("v").alias("n"))


@query("SELECT event_id, props AS sliced, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")
def json_slice(spark, sf_dir):
    df = table(spark, sf_dir, "events").withColumn("wrapped", F.concat(F.lit("Sure, here it is: "), "props", F.lit(" -- done.")))
    cut = df.select("event_id", T.json_slice(F.col("wrapped")).alias("sliced"))
    return cut.withColumn("sliced", T.strict_json(F.col("sliced"))).withColumn("k", F.from_json("sliced", "k int")["k"])


def _trace(spark, sf_dir):
    """Recorded answers of four evaluators in five rounds, worked out from the ids so that SQL can do the same."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("i"))
    names = F.array(*map(F.lit, panel.THRESHOLDS))
    score = F.pmod(F.col("i") * 7 + F.floor(F.col("i") / 20), F.lit(5))
    return d.select(
        F.floor(F.col("i") / 20).cast("bigint").alias("id_en"), (F.floor(F.pmod(F.col("i"), F.lit(20)) / 4) + 1).cast("int").alias("iteration"),
        F.element_at(names, (F.pmod(F.col("i"), F.lit(4)) + 1).cast("int")).alias("evaluator"),
        F.when(F.pmod(F.col("i"), F.lit(11)) == 0, F.lit("no idea")).otherwise(F.concat(F.lit("Rating: "), score.cast("string"), F.lit("\nJustification: \n because "), F.col("i").cast("string"), F.lit(" \n"))).alias("response"),
    )


_TRACE_SQL = """
WITH t AS (SELECT doc_id // 20 AS id_en, CAST((doc_id % 20) // 4 + 1 AS INT) AS iteration, ['equivalence', 'mistranslation', 'emotion', 'authenticity'][doc_id % 4 + 1] AS evaluator,
  [2, 2, 1, 3][doc_id % 4 + 1] AS need, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE CAST((doc_id * 7 + doc_id // 20) % 5 AS INT) END AS rating, doc_id FROM documents)
"""
_DECISIONS_SQL = _TRACE_SQL + """,
o AS (SELECT id_en, iteration, evaluator, min(rating) AS rating, min(need) AS need FROM t GROUP BY ALL),
d AS (SELECT id_en, iteration, coalesce(avg(rating), 0) AS average, count(rating) AS n_ratings, count(rating) = 4 AND coalesce(bool_and(rating >= need), false) AS accepted FROM o GROUP BY ALL)
"""


@query(_TRACE_SQL + "SELECT doc_id AS i, rating, CASE WHEN rating IS NULL THEN 'No justification' ELSE 'because ' || doc_id END AS justification FROM t")
def rating_parse(spark, sf_dir):
    r = panel.rated(_trace(spark, sf_dir))
    back = (F.col("id_en") * 20 + (F.col("iteration") - 1) * 4 + F.array_position(F.array(*map(F.lit, panel.THRESHOLDS)), F.col("evaluator")) - 1).alias("i")
    return r.select(back, "rating", "justification")


@query(_DECISIONS_SQL + "SELECT * FROM d")
def panel_decision(spark, sf_dir):
    return panel.decisions(_trace(spark, sf_dir))


@query(_DECISIONS_SQL + """,
s AS (SELECT id_en, min(CASE WHEN accepted THEN iteration END) AS stop FROM d GROUP BY id_en),
r AS (SELECT d.*, max(CASE WHEN accepted THEN 1 ELSE 0 END) OVER (PARTITION BY d.id_en) = 1 AS any_accepted FROM d JOIN s ON d.id_en = s.id_en WHERE stop IS NULL OR iteration <= stop)
SELECT id_en, iteration, average AS best_score, any_accepted AS accepted FROM r QUALIFY row_number() OVER (PARTITION BY id_en ORDER BY average DESC, iteration) = 1
""")
def best_iteration(spark, sf_dir):
    return panel.best_iteration(_trace(spark, sf_dir))


@query(_DECISIONS_SQL + "SELECT id_en, coalesce(min(CASE WHEN accepted THEN iteration END), max(iteration)) AS iteration FROM d GROUP BY id_en")
def last_iteration(spark, sf_dir):
    return panel.last_iteration(_trace(spark, sf_dir))


@query(_TRACE_SQL + """
SELECT id_en, iteration, 'KEY FEEDBACK:' || chr(10) || string_agg(evaluator || ': ' || CASE WHEN rating IS NULL THEN 'No justification' ELSE 'because ' || doc_id END, chr(10) || chr(10) ORDER BY doc_id % 4) AS feedback
FROM t GROUP BY id_en, iteration
""")
def feedback_block(spark, sf_dir):
    return panel.feedback(_trace(spark, sf_dir))


_STOP = ", ".join(lit(w) for w in T.STOP_WORDS)


@query(f"SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z'']+')) AS token FROM documents) WHERE token NOT IN ({_STOP}) GROUP BY token")
def token_frequency(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.explode(T.content_tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT trim(item) AS item, count(*) AS n FROM (SELECT unnest(list_concat(coalesce(first_context, []), coalesce(second_context, []))) AS item FROM translated) WHERE trim(item) <> '' GROUP BY 1")
def keyword_flatten(spark, sf_dir):
    empty = F.array().cast("array<string>")
    nested = F.flatten(F.array(F.coalesce("first_context", empty), F.coalesce("second_context", empty)))
    return metrics.item_frequency(table(spark, sf_dir, "translated"), F.transform(nested, F.trim))


@query("""
WITH v AS (SELECT user_id, list(CAST(floor(value) AS BIGINT) % 5) AS v FROM events WHERE value IS NOT NULL GROUP BY user_id)
SELECT user_id, CAST(list_sum(v) AS BIGINT) AS total, CASE WHEN list_sum(v) > 0 THEN CAST(list_sum(v) AS DOUBLE) / len(list_filter(v, lambda x: x <> 0)) ELSE 0 END AS mean FROM v
""")
def nonzero_mean(spark, sf_dir):
    rated = table(spark, sf_dir, "events").where("value IS NOT NULL").groupBy("user_id").agg(F.collect_list(F.floor("value") % 5).alias("v"))
    return rated.select("user_id", metrics.list_sum(F.col("v")).alias("total"), metrics.nonzero_mean(F.col("v")).alias("mean"))


@query("""
WITH r AS (SELECT min(n_chars) lo, max(n_chars) hi FROM documents)
SELECT CAST(least(floor((n_chars - lo) / ((hi - lo) / 10.0)), 9) AS INT) AS bin, count(*) AS n FROM documents, r WHERE n_chars IS NOT NULL GROUP BY 1
""")
def histogram(spark, sf_dir):
    return metrics.histogram(table(spark, sf_dir, "documents"), "n_chars")


@query("SELECT CAST(least(floor(l_discount * 100), 4) AS INT) AS bin, count(*) AS n FROM lineitem WHERE l_discount * 100 BETWEEN 0 AND 5 GROUP BY 1")
def unit_histogram(spark, sf_dir):
    return metrics.unit_histogram(table(spark, sf_dir, "lineitem").select((F.col("l_discount") * 100).alias("x")), "x")


@query("""
WITH c AS (SELECT ord, unnest(string_split(text_clean, '')) AS ch, generate_subscripts(string_split(text_clean, ''), 1) AS i FROM cleaned_en),
f AS (SELECT ch, min((ord, i)) AS pos, count(*) AS n FROM c WHERE ch <> '' GROUP BY ch)
SELECT ch, CAST(row_number() OVER (ORDER BY pos) AS INT) AS id, n FROM f
""")
def char_vocabulary(spark, sf_dir):
    return metrics.character_ids(table(spark, sf_dir, "cleaned_en"), "text_clean", "ord")


@query("SELECT rec_id, trim(lower(replace(pun_word, '_', ' '))) AS key, CASE WHEN regexp_full_match(trim(lower(replace(pun_word, '_', ' '))), '\\p{L}{3,20}') THEN trim(lower(replace(pun_word, '_', ' '))) END AS lemma, regexp_replace(pun_word, '[^\\p{L}\\p{N}_'']', '', 'g') AS bare FROM translated")
def lemma_cleanup(spark, sf_dir):
    w = F.col("pun_word")
    return table(spark, sf_dir, "translated").select("rec_id", T.key_form(F.replace(w, F.lit("_"), F.lit(" "))).alias("key"), T.simple_lemma(w).alias("lemma"), T.bare_word(w).alias("bare"))


@query("SELECT rec_id, nullif(lower(replace(pun_word_fr, '_', ' ')), '') AS term FROM translated")
def concept_terms(spark, sf_dir):
    concept = F.concat(F.lit("/c/fr/"), F.replace("pun_word_fr", F.lit(" "), F.lit("_")))
    return table(spark, sf_dir, "translated").select("rec_id", T.concept_term(concept).alias("term"))


@query("SELECT DISTINCT rec_id, 'Translate every value into French and keep the JSON keys.' || chr(10) || pun_word AS prompt, model, temperature FROM translated t, (SELECT unnest(['a', 'b']) AS m), (SELECT CAST(unnest([0.0, 0.7]) AS DOUBLE) AS temperature) WHERE pun_word IS NOT NULL AND model IS NOT NULL".replace("model, temperature FROM", "m AS model, temperature FROM").replace(" AND model IS NOT NULL", ""))
def prompt_sweep(spark, sf_dir):
    p = table(spark, sf_dir, "translated").where("pun_word IS NOT NULL").select("rec_id", T.prompt("translate", language=F.lit("French"), values=F.col("pun_word")).alias("prompt"))
    return pipelines.sweep(p, ["a", "b"], [0.0, 0.7])


@query("""
SELECT rec_id, CASE WHEN lower(trim(pun_word)) = lower(trim(pun_word_fr)) THEN 1 ELSE rec_id % 2 END AS match,
  CASE WHEN lower(trim(pun_word)) = lower(trim(pun_word_fr)) OR rec_id % 2 = 1 THEN pun_word_fr ELSE 'false' END AS predicted FROM translated
""")
def alternative_words(spark, sf_dir):
    df = table(spark, sf_dir, "translated").withColumn("verdict", F.col("rec_id") % 2)
    return pipelines.alternative_words(df, "pun_word", "pun_word_fr", "verdict").select("rec_id", "match", "predicted")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
