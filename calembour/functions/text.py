"""String functions as column expressions: cleaning, parsing, tokens, prompts.

Null in gives null out unless said otherwise. All of it stays inside the JVM, but for
the strict JSON check, which has no built-in counterpart.
"""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Literal replacements of the cleaning step, in order.
LITERALS = [
    (r"\n", " "),
    ("''said Tom blankly.", '"", said Tom blankly.'),
    ("''", '"'),
    (" - ", "-"),
    ('",', ',"'),
    ("3. ", "3."),
    (".'.", ".'"),
    (": )", "."),
    ("……………..", "…"),
]
# Hashtags and links that the cleaning step deletes, in order.
DELETED = [
    "#dadjoke", "#funny", "#instagramposts", "#instagramreels", "#hipster", "#LOL", "#GenZ", "#JossOfAlva", "#Comedy", "#Pun",
    "#joke", "#pun", "#dadjokes", "#Humour", "#Jokes", "#wordplay", "#OneLiner", "#FunQuestion", "https://t.co/Gvt90HO0LB", "https://t.co/busgJ9Th4z",
]
# Inverted speech tags and their plain order.
INVERSIONS = [
    ("said Tom", "Tom said"),
    ("spouted Tom", "Tom spouted"),
    ("asked Tom", "Tom asked"),
    ("yelled Tom", "Tom yelled"),
    ("reported Tom", "Tom reported"),
    ("cried Tom's band", "Tom's band cried"),
]
#: White space as Unicode has it, spelt so that Java and RE2 agree.
BLANK = r"[\t-\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

# English function words that the detectors skip.
STOP_WORDS = (
    "the a an and or but if then else to of in on at for with is are was were be been being it this that these those "
    "i you he she we they me him her us them my your his their as by from not no so"
).split()


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once, however often ``body`` names it.

    Without this the steps of a long chain would be copied into each other.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Literal replacements one after the other."""
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)


def without_prefix(text: Column, prefix: str) -> Column:
    return let(text, lambda t: F.when(t.startswith(prefix), F.substring(t, len(prefix) + 1, 1_000_000_000)).otherwise(t))


def words(text: Column) -> Column:
    """Split at white space, no empty words."""
    return F.filter(F.split(text, BLANK + "+"), lambda w: w != "")


def lower_shouted_openings(text: Column) -> Column:
    """After an opening ``OLD``, the run of upper-case words becomes lower case; white space is normalised in every text.

    Words of one or two letters are neither changed nor end the run, which ends at the
    first longer word that is not in capitals.
    """
    upper = lambda x: (x == F.upper(x)) & (x != F.lower(x))

    def end_of_run(w: Column) -> Column:
        return F.coalesce(F.array_position(F.transform(w, lambda x, i: (i > 0) & (F.length(x) > 2) & ~upper(x)), True), F.lit(0))

    def lowered(w: Column) -> Column:
        one = lambda stop: F.transform(w, lambda x, i: F.when(i == 0, F.lit("Old")).when((F.length(x) > 2) & ((stop == 0) | (i < stop - 1)), F.lower(x)).otherwise(x))
        return let(end_of_run(w), one)

    return let(words(text), lambda w: F.array_join(F.when(F.get(w, F.lit(0)) == "OLD", lowered(w)).otherwise(w), " "))


def plain_speech_tags(text: Column) -> Column:
    """Inverted speech tags put right; a rule applies only where the text as it came in has the tag."""
    # replacing an empty search text changes nothing
    return let(text, lambda t: reduce(lambda c, p: F.replace(c, F.when(t.contains(p[0]), F.lit(p[0])).otherwise(F.lit("")), F.lit(p[1])), INVERSIONS, t))


def quoted_speech(text: Column) -> Column:
    """For each of , ! ? before `` Tom``: a quote at the beginning and one after the mark."""
    def one(c: Column, p: str) -> Column:
        return let(c, lambda t: F.when(t.contains(f"{p} Tom"), F.concat(F.lit('"'), F.replace(t, F.lit(f"{p} Tom"), F.lit(f'{p}" Tom')))).otherwise(t))

    return reduce(one, [",", "!", "?"], text)


def pronouns(text: Column) -> Column:
    return replaced(text, [("Tom's", "his"), ("Tom", "he")])


def dashes_to_sentences(text: Column) -> Column:
    """`` -- x`` becomes ``. X``."""
    parts = F.split(text, r" -- (?=[\p{L}\p{N}_])")
    return F.array_join(F.transform(parts, lambda p, i: F.when(i > 0, F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1_000_000_000))).otherwise(p)), ". ")


def clean_text(text: Column) -> Column:
    """The whole cleaning step, in its fixed order."""
    t = without_prefix(replaced(text, LITERALS), "- ")
    t = replaced(t, [(d, "") for d in DELETED])
    return dashes_to_sentences(pronouns(quoted_speech(plain_speech_tags(lower_shouted_openings(t)))))


def json_slice(text: Column) -> Column:
    """From the first ``{`` to the last ``}``; null if there is no such stretch."""
    def cut(t: Column) -> Column:
        first, last = F.instr(t, "{"), F.length(t) - F.instr(F.reverse(t), "}") + 1
        return F.when((first > 0) & t.contains("}") & (last > first), F.substring(t, first, last - first + 1))

    return let(text, cut)


@F.pandas_udf(StringType())
def strict_json(texts: pd.Series) -> pd.Series:
    """The text where it is exactly one JSON document, else null (trailing text and single quotes are refused)."""

    def check(t: str) -> str | None:
        try:
            json.loads(t)
        except ValueError:
            return None
        return t

    return texts.map(check, na_action="ignore")


def list_literal(text: Column) -> Column:
    """A list as Python or JSON prints it, to an array; null for anything else."""
    read = F.from_json(text, "array<string>", {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"})
    return F.when(text.rlike(r"(?s)^\s*\[.*\]\s*$"), read)


def list_text(array: Column) -> Column:
    return F.to_json(array)


def rating(response: Column) -> Column:
    """The first ``Rating: n``; null without one."""
    return F.regexp_extract(response, r"Rating:\s*(\d+)", 1).try_cast("int")


def justification(response: Column) -> Column:
    """What follows ``Justification:``, to the end, trimmed; ``No justification`` without one."""
    found = F.regexp_replace(F.regexp_extract(response, r"(?s)Justification:\s*(.*)", 1), r"^\s+|\s+$", "")
    return F.when(response.rlike("Justification:"), found).otherwise("No justification")


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and apostrophes of the lower-case text."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z']+)"), F.lit(1))


def content_tokens(text: Column) -> Column:
    return F.filter(tokens(text), lambda t: ~t.isin(STOP_WORDS))


def bare_word(word: Column) -> Column:
    """Letters, digits, underscores and apostrophes only."""
    return F.regexp_replace(word, r"[^\p{L}\p{N}_']", "")


#: Stands where ``marked_bare`` took something out; no letter, digit or white space itself.
MARK = "\0"


def marked_bare(text: Column) -> Column:
    """``bare_word`` for all words of a text at once: without the marks its words are bare, and those that have nothing left stay words."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}_'" + BLANK[1:], MARK)


def key_form(text: Column) -> Column:
    return F.lower(F.trim(text))


def concept_term(concept: Column, lang: str = "fr") -> Column:
    """The term of a concept id ``/c/<lang>/<term>``; null for other ids."""
    term = F.regexp_extract(concept, rf"^/c/{lang}/(.+)$", 1)
    return F.when(term != "", F.lower(F.replace(term, F.lit("_"), F.lit(" "))))


def simple_lemma(lemma: Column) -> Column:
    """A lemma in key form if it is one word of 3 to 20 letters, else null."""
    t = key_form(F.replace(lemma, F.lit("_"), F.lit(" ")))
    return F.when(t.rlike(r"^\p{L}{3,20}$"), t)


def prompt(task: str, **values: Column) -> Column:
    """A prompt from a template with ``%s`` in the order of ``values``."""
    return F.format_string(TEMPLATES[task], *values.values())


TEMPLATES = {
    "identify": "Find the wordplay in the sentence below.\nSentence: %s\nAnswer with one JSON object with the keys pun_word, pun_type, first_meaning, second_meaning, first_context, second_context.",
    "translate": "Translate every value into %s and keep the JSON keys.\n%s",
    "generate": "Write one French sentence that puns on %s or %s, close to: %s\nAnswer with JSON: {\"generated_pun\": ...}",
    "homonym": "Is %s a homonym in French, and do its senses overlap with %s and %s? Answer with JSON flags 0 or 1.",
    "judge": "%s\nDoes the next text contain a pun? %s\nAnswer with JSON: {\"is_pun\": 0 or 1}",
    "back_translate": "Translate every value from %s into English and keep the JSON keys.\n%s",
    "evaluate": "Rate the %s of this French pun.\nSource: %s\nPun: %s\nAnswer with two lines: Rating: <number> and Justification: <text>",
    "refine": "Improve this French pun.\nSource: %s\nCurrent: %s\n%s\nReturn only the new sentence.",
}
