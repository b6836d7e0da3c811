"""One form for texts that a reader sees as the same.

Three steps, all on whole texts:

1. Characters nobody sees (format controls, soft hyphens, variation selectors, stray
   controls) are deleted; width variants, ligatures and spaces take their plain form.
2. Every word becomes a lattice: each letter stands for all letters that look like it
   in Latin, Cyrillic and Greek. The lattice does not depend on which of them was
   written, so words that look alike always get the same answer. Viterbi picks the
   path with the best character-bigram score, with a price for changing the script
   inside a word and a bonus for the script of the text's unmistakable letters.
3. Accents are composed again (NFC).

Case, accents, punctuation, words and their order stay as they are.

Defined cases: null stays null and matches nothing; an empty or blank text becomes the
empty string and matches nothing either, for it shows no text; texts of any length are
treated whole; exact copies are not a pair, for they are the same string.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calembour.operators.layout import frames, spread
from calembour.operators.skew import salted_join
from calembour.session import checkpointed, ship

# Letters drawn alike, as Latin letter: Cyrillic letter, Greek letter, other Latin letters ('' = none).
ALIKE = {
    "A": ("А", "Α", ""),
    "B": ("В", "Β", ""),
    "C": ("С", "Ϲ", ""),
    "E": ("Е", "Ε", ""),
    "H": ("Н", "Η", ""),
    "I": ("І", "Ι", ""),
    "J": ("Ј", "Ϳ", ""),
    "K": ("К", "Κ", ""),
    "M": ("М", "Μ", ""),
    "N": ("", "Ν", ""),
    "O": ("О", "Ο", ""),
    "P": ("Р", "Ρ", ""),
    "S": ("Ѕ", "", ""),
    "T": ("Т", "Τ", ""),
    "X": ("Х", "Χ", ""),
    "Y": ("Ү", "Υ", ""),
    "Z": ("", "Ζ", ""),
    "a": ("а", "", "ɑ"),
    "c": ("с", "ϲ", ""),
    "d": ("ԁ", "", ""),
    "e": ("е", "", ""),
    "g": ("", "", "ɡ"),
    "h": ("һ", "", ""),
    "i": ("і", "", ""),
    "j": ("ј", "ϳ", ""),
    "l": ("ӏ", "", ""),
    "o": ("о", "ο", ""),
    "p": ("р", "", ""),
    "q": ("ԛ", "", ""),
    "s": ("ѕ", "", ""),
    "w": ("ԝ", "", ""),
    "x": ("х", "", ""),
    "y": ("у", "", ""),
}
SCRIPTS = ("latin", "cyrillic", "greek")
#: A word of Latin letters with at least one that looks like no other script's: its lattice has one path.
SURELY_LATIN = re.compile(f"(?=.*[{''.join(c for c in 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz' if c not in ALIKE)}])[A-Za-z\u0300-\u036F]+")
LATIN_OF = {c: latin for latin, others in ALIKE.items() for group in others for c in group}
#: What each class member looks like in each script.
IN_SCRIPT = {latin: (latin, others[0] or None, others[1] or None) for latin, others in ALIKE.items()}

INVISIBLE = re.compile(r"[\u0000-\u0008\u000E-\u001F\u007F-\u0084\u0086-\u009F\u00AD\u034F\u061C\u115F\u1160\u17B4\u17B5\u180B-\u180F\u200B-\u200F\u202A-\u202E\u2060-\u206F\u3164\uFE00-\uFE0F\uFEFF\uFFA0\uFFF9-\uFFFB\U000E0000-\U000E0FFF]")
#: Blanks that are not a single space already; line breaks stay.
BLANKS = re.compile(r"[^\S\n ][^\S\n]*| [^\S\n]+")
LINES = re.compile(r" ?\n ?")
WORD = re.compile(r"[^\W\d_](?:[^\W\d_]|[\u0300-\u036F])*")
AROUND_WORDS = re.compile(f"({WORD.pattern})")
#: Compatibility forms that differ in width or joining only; superscripts, circles and the like look different.
PLAIN = ("<wide>", "<narrow>", "<compat>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>")

SWITCH, PRIOR, FLOOR = 9.0, 6.0, 0.5


@lru_cache(maxsize=65_536)
def plain(ch: str) -> str:
    d = unicodedata.decomposition(ch)
    return unicodedata.normalize("NFKC", ch) if d.startswith(PLAIN) else ch


class Shown(dict):
    """Translation table of step 1: what is seen of each character in its plain form."""

    def __missing__(self, code: int) -> str:
        seen = self[code] = INVISIBLE.sub("", plain(chr(code)))
        return seen


@lru_cache(maxsize=65_536)
def script(ch: str) -> int:
    """0 Latin, 1 Cyrillic, 2 Greek, -1 anything else."""
    code = ord(ch)
    if code < 0x250 or 0x1E00 <= code < 0x1F00 or 0x250 <= code < 0x2B0 or 0x2C60 <= code < 0x2C80:
        return 0 if ch.isalpha() else -1
    if 0x400 <= code < 0x530 or 0x2DE0 <= code < 0x2E00 or 0xA640 <= code < 0xA6A0:
        return 1
    if 0x370 <= code < 0x400 or 0x1F00 <= code < 0x2000:
        return 2
    return -1


class Telling(dict):
    """Translation table that leaves the script number of letters that look like no other script's."""

    def __missing__(self, code: int) -> str:
        s = script(chr(code))
        mark = self[code] = "" if s < 0 or chr(code) in IN_SCRIPT else str(s)
        return mark


class Bones(dict):
    """Translation table of letters to the Latin ones they look like."""

    def __missing__(self, code: int) -> int | str:
        bone = self[code] = LATIN_OF.get(chr(code), code)
        return bone


SHOWN, TELLING, BONES = Shown(), Telling(), Bones()


def visible(text: str) -> str:
    """Step 1, decomposed (NFD)."""
    if text.isascii():
        t = INVISIBLE.sub("", text)
    else:
        t = unicodedata.normalize("NFD", text.translate(SHOWN))
    t = BLANKS.sub(" ", t)
    return (LINES.sub("\n", t) if "\n" in t else t).strip()


def skeleton(word: str) -> str:
    return word if word.isascii() else word.translate(BONES)


class Scores:
    """Log-likelihoods of character bigrams, by script; word ends count as ``^`` and ``$``."""

    def __init__(self, counts: dict[str, int]):
        self.counts = counts
        self.before = Counter()
        for k, n in counts.items():
            self.before[k[0]] += n
        self.memo: tuple[dict[str, str], ...] = ({}, {}, {})  # by main script

    def step(self, a: str, b: str) -> float:
        return math.log((self.counts.get(a + b, 0) + FLOOR) / (self.before.get(a, 0) + FLOOR * 120))

    def best(self, word: str, main: int) -> str:
        """The best path through the lattice of ``word`` (a skeleton); marks ride along."""
        known = self.memo[main]
        got = known.get(word)
        if got is None:
            if len(known) > 200_000:
                known.clear()
            got = known[word] = self._search(word, main)
        return got

    def _search(self, word: str, main: int) -> str:
        if SURELY_LATIN.fullmatch(word):
            return word
        letters = [c for c in word if not "\u0300" <= c <= "\u036F"]
        fixed = {script(c) for c in letters if c not in IN_SCRIPT}
        if len(fixed) == 1:
            s = next(iter(fixed))
            if s >= 0 and all(c not in IN_SCRIPT or IN_SCRIPT[c][s] for c in letters):
                return "".join(IN_SCRIPT[c][s] if c in IN_SCRIPT else c for c in word)
        low = {}  # state: script of the last letter -> (score, letters)
        for i, c in enumerate(letters):
            options = [(s, IN_SCRIPT[c][s]) for s in range(3) if IN_SCRIPT[c][s]] if c in IN_SCRIPT else [(script(c), c)]
            now = {}
            for s, x in options:
                bonus = PRIOR / len(letters) * 2 if s == main else 0.0
                if i == 0:
                    now[s] = (self.step("^", x.lower()) + bonus, x)
                else:
                    now[s] = max((v + self.step(path[-1].lower(), x.lower()) - SWITCH * (s != p) + bonus, path + x) for p, (v, path) in low.items())
            low = now
        path = max((v + self.step(p[-1].lower(), "$"), -s, p) for s, (v, p) in low.items())[2]
        it = iter(path)
        return "".join(c if "\u0300" <= c <= "\u036F" else next(it) for c in word)

    def canonical(self, text: str | None) -> str | None:
        if text is None:
            return None
        t = visible(text)
        bones = skeleton(t)
        main = 0
        if not bones.isascii():
            sure = bones.translate(TELLING)
            main = max(range(3), key=lambda s: (sure.count(str(s)), -s))
        parts = AROUND_WORDS.split(bones)
        parts[1::2] = [self.best(w, main) for w in parts[1::2]]
        out = "".join(parts)
        return out if out.isascii() else unicodedata.normalize("NFC", out)


def bigram_counts(df: DataFrame, text: str) -> DataFrame:
    """``pair``, ``n``: character bigrams of all words in one script, over all rows.

    Each task adds up its own rows first, so the shuffle carries the alphabet's square,
    not the text.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for b in batches:
            words: Counter = Counter()
            for t in b["t"].dropna():
                words.update(WORD.findall(visible(t)))
            for w, n in words.items():
                letters = [c.lower() for c in w if not "\u0300" <= c <= "\u036F"]
                if len({script(c) for c in letters}) == 1 and script(letters[0]) >= 0:
                    for a, z in zip(["^", *letters], [*letters, "$"], strict=True):
                        if len(a) == len(z) == 1:
                            seen[a + z] += n
        yield pd.DataFrame({"pair": list(seen), "n": list(seen.values())})

    return spread(df.select(F.col(text).alias("t"))).mapInPandas(frames(count), "pair string, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def train(df: DataFrame, text: str) -> Scores:
    """Bigram model of a column. Only letters of three scripts count, so the model has at most the square of ~2,000 letters
    whatever the table's size, and may be sent to every task."""
    return Scores({r["pair"]: r["n"] for r in bigram_counts(df, text).toLocalIterator()})


def canonical_udf(scores: Scores):
    counts = scores.counts

    @F.pandas_udf("string")
    def canonical(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = Scores(counts)
        for b in batches:
            yield b.map(model.canonical, na_action="ignore")

    return canonical


def one_form(df: DataFrame, text: str, scores: Scores | None = None, to: str = "canonical") -> DataFrame:
    """``df`` with the column ``to``: ``text`` in its one form."""
    ship(df.sparkSession)
    return df.withColumn(to, canonical_udf(scores or train(df, text))(F.col(text).cast("string")))


def _lanes(column: Column, name: str) -> list[Column]:
    return [F.xxhash64("part", column).alias(f"{name}1"), F.xxhash64(F.lit("second"), "part", column).alias(f"{name}2")]


def same_looking_pairs(df: DataFrame, key: str, text: str, scores: Scores | None = None, part: str | None = None) -> DataFrame:
    """``a``, ``b`` (a < b): rows whose texts look the same but are different strings.

    With ``part`` only rows of the same part are compared, and ``part`` comes out too, so
    that several tables can go through in one pass.

    Equal strings form a class first; classes of one look are paired, and only then
    expanded to rows, so a text that fills a third of the table is never compared with
    itself. Rows of such a class are spread over tasks.
    """
    named = (F.col(part) if part else F.lit("")).cast("string").alias("part")
    formed = one_form(spread(df.select(F.col(key).alias("id"), named, F.col(text).cast("string").alias("t"))), "t", scores).where("canonical <> ''")
    # five numbers a row, written once: the normalization is not repeated for each use
    rows = checkpointed(formed.select("id", "part", *_lanes(F.col("canonical"), "c"), *_lanes(F.col("t"), "t")))
    total = df.count()
    classes = rows.groupBy("c1", "c2", "t1", "t2").agg(F.count(F.lit(1)).alias("n"))
    looks = classes.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("m")).where("m > 1").drop("m")
    several = classes.join(looks, ["c1", "c2"])
    left = several.select("c1", "c2", F.col("t1").alias("a1"), F.col("t2").alias("a2"), F.col("n").alias("na"))
    right = several.select("c1", "c2", F.col("t1").alias("b1"), F.col("t2").alias("b2"), F.col("n").alias("nb"))
    pairs = left.join(right, ["c1", "c2"]).where("a1 < b1 OR (a1 = b1 AND a2 < b2)").drop("c1", "c2")
    members = rows.select("id", "t1", "t2")
    parts = rows.select("id", "part", "t1", "t2")
    counts_a = several.select(F.col("t1").alias("a1"), F.col("t2").alias("a2"), F.col("n").alias("na"))
    a = salted_join(members.toDF("ida", "a1", "a2"), pairs, ["a1", "a2"], "na", total, F.col("ida"), counts=counts_a).select("ida", "b1", "b2", "nb")
    counts_b = several.select(F.col("t1").alias("b1"), F.col("t2").alias("b2"), F.col("n").alias("nb"))
    both = salted_join(parts.toDF("idb", "part", "b1", "b2"), a, ["b1", "b2"], "nb", total, F.col("idb"), counts=counts_b)
    return both.select(*(["part"] if part else []), F.least("ida", "idb").alias("a"), F.greatest("ida", "idb").alias("b")).where("a < b")
