"""Defects of model answers: empty, refusal, copy, wrong language, truncated.

Every answer field is looked at alone, in one pass without a shuffle:

* *empty*: nothing, no letter or digit, or a stand-in for nothing or for an error;
* *refusal*: a refusal grammar (apology, speaker, inability) that must open the answer,
  so a joke that ends in an apology is none;
* *copy*: greedy string tiling against the question; the tiles cover it nearly whole;
* *wrong_language*: scripts and function words tell another language than expected;
* *truncated*: a pushdown parser over fences, brackets, quotations, lists and markup
  finds something left open, or the sentence has no end.

The first that fits is reported, so there is at most one per field. Null questions are
compared as empty ones; texts of any length are read whole; repeated rows repeat; other
columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calembour.operators.layout import carried, frames, spread

# What stands for nothing or for an error.
STAND_INS = frozenset("null none nil nan na n/a error undefined empty missing unknown void tbd blank failed failure timeout aucun aucune rien vide néant erreur".split()) | {
    "no answer",
    "not available",
    "not applicable",
    "no response",
    "no output",
    "no result",
    "sans réponse",
    "non disponible",
    "internal error",
    "api error",
    "parse error",
}

# Common function words of each language.
FUNCTION_WORDS = {
    "fr": "le la les un une du des à au aux et que qui dans pour est l n d c qu s j sur chaque avec sans en de mot dit ne se pas mais il elle parce a ont ni ce cette son sa contre chez pourquoi fait".split(),
    "en": "the a an and of to in on at with was were is are it for but that this by his her he she they from under used not be been has had what why when never just into who as or".split(),
    "de": "der die das den dem ein eine einen und ist nicht mit im zu hat für auf über sich war wenn wird warum weil immer trotzdem von sagt dass".split(),
    "es": "el la los las un una y que con del en es por para no se al su porque nadie más pero como dicen qué cuando".split(),
    "it": "il lo la gli i un una e che con del della di è per non si ha ma ogni come perché dice nel al le va".split(),
    "pt": "o a os as um uma e que com do da de em é por para não se na no mas porque entre ninguém ao".split(),
    "nl": "de het een en van is niet met in op te zit er tussen altijd wel volgens maar dat voor aan die waarom omdat".split(),
}
TELLING = {lang: frozenset(ws) for lang, ws in FUNCTION_WORDS.items()}

SPEAKER = r"(?:i|we|je|j|nous|ich|wir|yo|io|eu|ik)"
APOLOGY = r"(?:(?:i am|i m|i'm|je suis|nous sommes|es tut mir|lo|mi|me)?\s*(?:so |very |vraiment |sincèrement )?(?:sorry|apologi[sz]e|apologies|unfortunately|regrettably|désolée?|désolés|navrée?|pardon|malheureusement|leid|leider|siento|lamento|lamentablemente|dispiace|purtroppo|desculpe|infelizmente|helaas|regrets?|regrette)\b[\s,;:.!\-—]*(?:but|mais|aber|pero|maar|mas|ma)?[\s,]*)"
ROLE = r"(?:(?:as|being) an? [\w\s\-]{0,30}?(?:model|assistant|ai)|en tant qu[e'’]\s*[\w\s\-']{0,40}?(?:langage|langue|assistante?|ia)|als (?:ki|sprachmodell)[\w\s\-]{0,30}?|como (?:modelo|asistente)[\w\s\-]{0,30}?)[\s,]*"
UNABLE = (
    r"(?:(?:can\s?not|can[’']?\s?t|could not|couldn[’']?t|am unable|m unable|am not able|m not able|won[’']?t be able|will not be able|do not|don[’']?t (?:see|know|think|have|feel|find|understand|want)|must decline|have to decline|decline|refuse|[’' ]?d rather not|would rather not|prefer not|am not comfortable|am not allowed|won[’']?t|will not)"
    r"|(?:ne (?:peux|pouvons|puis|sais|saurais|vois|souhaite|suis)(?: malheureusement)? (?:pas|en mesure|rien|aucun)|ne (?:peux|puis|saurais)|n[’' ](?:ai|arrive|y arrive) pas|suis (?:dans l[’' ]incapacité|incapable)|refuse|préfère(?:rais)? ne pas|dois (?:refuser|décliner))"
    r"|(?:kann|können|darf|möchte|werde)\b.{0,60}\bnicht|(?:no puedo|no podemos|no sé|no me es posible|prefiero no)|(?:non posso|non sono in grado|non riesco|preferisco non)|(?:não posso|não consigo|não sou capaz|prefiro não)|(?:kan|mag)\b.{0,60}\bniet)"
)
IMPERSONAL = (
    r"(?:(?:it is|it's|this is) (?:not possible|impossible)|(?:no|not an?) (?:\w+ ){0,2}?(?:possible|available)|cannot be|can(?:no|')?t be|could not be|not possible|not enough (?:context|information)|unable to|impossible (?:to|de|d[’'])|il (?:m[’' ]est|est|n[’' ]est pas) (?:impossible|possible)|not able to|refus(?:al|ed)|request (?:denied|declined|refused)|no es posible|non è possibile|não é possível|nicht möglich|es ist mir nicht|incapable de|dans l[’']impossibilité)"
)
REFUSAL = re.compile(rf"^[\W_]*(?:(?>{APOLOGY})|{ROLE})*(?:{SPEAKER}[\s’']*{UNABLE}|{UNABLE}|{IMPERSONAL}|{SPEAKER}\s+(?:\w+\s+){{0,3}}?impossible)", re.I)
BARE_APOLOGY = re.compile(rf"^[\W_]*(?:(?>{APOLOGY})|{ROLE})+[^.!?]*[.!?]*\s*$", re.I)

WORD = re.compile(r"[^\W_]+")
JOINED = re.compile(r"(?<=\w)['’ʼ\-‐‑](?=\w)")
TERMINAL = ".!?。！？"
CLOSERS = "»”\"')]}’*_`›"
OPENING = {"«": "»", "“": "”", "(": ")", "[": "]", "{": "}", "‹": "›", "„": "“"}
COPIED = 0.75
MIN_TILE = 2


def tokens(text: str) -> list[str]:
    return [w.casefold() for w in WORD.findall(JOINED.sub("", unicodedata.normalize("NFKC", text)))]


def tiled(a: list[str], b: list[str], least: int = MIN_TILE) -> int:
    """Tokens of ``a`` covered by the tiles of greedy string tiling with ``b``: the longest common run first, each token once.

    Runs of one length are laid together, the first in ``a`` and then in ``b`` first, so a
    length costs one pass over what is still free. Tiles of different lengths lie side by
    side, so there are no more lengths than the square root of twice the tokens; texts
    that say the same over and over need no other way.
    """
    if not a or not b:
        return 0
    least = min(least, len(a), len(b))
    if set(zip(*(a[k:] for k in range(least)), strict=False)).isdisjoint(zip(*(b[k:] for k in range(least)), strict=False)):
        return 0
    # runs of 2 ** k tokens by number: two of them name a run of any length
    names: list[tuple[list[int], list[int]]] = []
    known: dict = {}
    names.append(tuple([known.setdefault(w, len(known)) for w in s] for s in (a, b)))
    free_a, free_b = [(0, len(a))], [(0, len(b))]

    def runs(side: int, free: list[tuple[int, int]], n: int) -> Iterator[tuple[int, tuple[int, int]]]:
        k = n.bit_length() - 1
        while len(names) <= k:
            half, seen = 1 << len(names) - 1, {}
            names.append(tuple([seen.setdefault(p, len(seen)) for p in zip(s, s[half:], strict=False)] for s in names[-1]))
        s, rest = names[k][side], n - (1 << k)
        for first, end in free:
            last = end - n + 1
            if last > first:
                yield from zip(range(first, last), zip(s[first:last], s[first + rest : last + rest], strict=True), strict=True)

    def common(n: int) -> bool:
        mine = {run for _, run in runs(0, free_a, n)}
        return bool(mine) and any(run in mine for _, run in runs(1, free_b, n))

    covered = 0
    most = min(len(a), len(b))
    while most >= least and common(least):
        # the longest length of a common run: first by doubling, then by halving
        low, high = least, most
        while low < high:
            n = min(2 * low, high) if high == most else (low + high + 1) // 2
            if common(n):
                low = n
            else:
                high = n - 1
        starts: dict[tuple[int, int], deque[int]] = {}
        for j, run in runs(1, free_b, low):
            starts.setdefault(run, deque()).append(j)
        taken, laid_a, laid_b, end = bytearray(len(b)), [], [], 0
        for i, run in runs(0, free_a, low):
            if i < end or run not in starts:
                continue
            ends = starts[run]
            # tiles of this length that overlap a run hold its first or its last token
            while ends and (taken[ends[0]] or taken[ends[0] + low - 1]):
                ends.popleft()
            if ends:
                j, end = ends[0], i + low
                taken[j : j + low] = b"\1" * low
                laid_a.append(i)
                laid_b.append(j)
        covered += low * len(laid_a)
        free_a, free_b = without(free_a, laid_a, low, least), without(free_b, sorted(laid_b), low, least)
        most = min(low - 1, max((e - s for s, e in free_a), default=0), max((e - s for s, e in free_b), default=0))
    return covered


def without(free: list[tuple[int, int]], laid: list[int], n: int, least: int) -> list[tuple[int, int]]:
    """The stretches ``free`` less the tiles of ``n`` tokens that begin at ``laid``; what is shorter than ``least`` is left out."""
    out, k = [], 0
    for first, end in free:
        while k < len(laid) and laid[k] < end:
            out.append((first, laid[k]))
            first = laid[k] + n
            k += 1
        out.append((first, end))
    return [(s, e) for s, e in out if e - s >= least]


def covered_by_short_runs(a: list[str], b: list[str], least: int) -> int:
    """Tokens of ``a`` in runs of ``least`` tokens that ``b`` has too, each run of ``b`` used once.

    Runs of ``b`` may overlap here, so this is no tiling and judges no answer."""
    free = Counter(tuple(b[j : j + least]) for j in range(len(b) - least + 1))
    covered = end = 0
    for i in range(len(a) - least + 1):
        run = tuple(a[i : i + least])
        if free[run] > 0:
            free[run] -= 1
            covered += i + least - max(end, i)
            end = i + least
    return covered


def is_copy(answer: list[str], question: list[str]) -> bool:
    """Whether the answer gives back the question as a whole or nearly so."""
    if len(question) < 3 or len(answer) < 3:
        return bool(question) and answer == question
    return tiled(question, answer) >= COPIED * len(question)


def languages(words: list[str]) -> dict[str, int]:
    return {lang: sum(w in telling for w in words) for lang, telling in TELLING.items()}


def foreign(text: str, expected: str) -> bool:
    """Whether script and function words speak for another language than ``expected``."""
    letters = [c for c in text if c.isalpha()]
    if not letters:
        return False
    latin = sum("LATIN" in unicodedata.name(c, "") for c in letters if c > "\x7f") + sum(c <= "\x7f" for c in letters)
    if latin < 0.5 * len(letters):
        return True
    words = [w.casefold() for w in WORD.findall(text)]
    hits = languages(words)
    own = hits.pop(expected)
    lang, best = max(hits.items(), key=lambda x: x[1])
    if len(words) >= 4 and own == 0 and best == 0:
        return True
    return best > own or (best == own and best > 0 and lang == "en" and own / len(words) < 0.1)


class Pushdown:
    """What is open at the end of a text: fences, brackets, quotations, markup, list items."""

    TOKEN = re.compile(r"```|~~~|\*\*|__|<(/?)([A-Za-z][\w-]*)[^<>]*?(/?)>|<[A-Za-z/][^<>]*$|[«»“”„‹›()\[\]{}\"]|\n")

    def __init__(self, text: str):
        self.stack: list[str] = []
        fence = None
        for m in self.TOKEN.finditer(text):
            t = m[0]
            if fence:
                if t == fence:
                    fence = None
                continue
            if t in ("```", "~~~"):
                fence = t
            elif t in ("**", "__", '"'):
                # the same sign opens and closes
                if t in self.stack:
                    while self.stack.pop() != t:
                        pass
                else:
                    self.stack.append(t)
            elif t[0] == "<":
                if t[-1] != ">":
                    self.stack.append("<")
                elif m[1]:
                    if m[2] in self.stack:
                        while self.stack.pop() != m[2]:
                            pass
                elif not m[3] and m[2].lower() not in ("br", "hr", "img", "p", "li"):
                    self.stack.append(m[2])
            elif t in OPENING:
                if t in "([" and m.start() and text[m.start() - 1] in ":;=":
                    continue  # a face, not a bracket
                self.stack.append(OPENING[t])
            elif t in self.stack:
                while self.stack.pop() != t:
                    pass
        if fence:
            self.stack.append(fence)
        last = text.rstrip().rsplit("\n", 1)[-1].strip()
        #: a list mark with nothing behind it
        self.bare_item = bool(re.fullmatch(r"(?:[-*•]|\d+[.)])", last))

    @property
    def open(self) -> bool:
        return bool(self.stack) or self.bare_item


def breaks_off(text: str) -> bool:
    t = text.rstrip()
    if Pushdown(t).open:
        return True
    while t and (t[-1] in CLOSERS or t[-1].isspace()):
        if t[-1] in ")»”":
            # a closed aside or quotation may end the text by itself
            return False
        t = t[:-1]
    return not t or t[-1] not in TERMINAL


def empty(text: str | None) -> bool:
    if text is None:
        return True
    t = text.strip().strip("\"'`«»“”‘’()[]{}<>.!?:;-_  ").casefold()
    return not any(c.isalnum() for c in t) or t in STAND_INS


def refuses(text: str) -> bool:
    t = text.strip().replace("’", "'")
    return bool(REFUSAL.match(t) or (BARE_APOLOGY.match(t) and len(t.split()) < 12 and not re.match(r"^\W*(?:pardon|leider|lamento)\b", t, re.I)))


TYPES = ("homographic", "homophonic")
FOREIGN_TYPE = re.compile(r"h?omo[\s-]?(?:gr[aá]f|graph|f[oóô]n|phon)\w*$")


def word_defect(answer: str, question: str) -> str | None:
    """Of ``pun_word``: one English word of the question."""
    word = unicodedata.normalize("NFKC", answer).strip().rstrip(".").strip().strip("\"'«»“”‘’ ").casefold()
    asked = unicodedata.normalize("NFKC", question).casefold()
    mine, theirs = tokens(answer), tokens(question)
    if re.fullmatch(r"[\w'’\-]+", word) and re.search(rf"(?<!\w){re.escape(word)}(?!\w)", asked):
        # a function word that begins another word of the question is what is left of that word
        return "truncated" if word in TELLING["en"] and any(len(w) > len(word) + 1 and w.startswith(word) for w in theirs) else None
    if is_copy(mine, theirs):
        return "copy"
    parts = re.findall(r"[^\W_]+(?:['’\-][^\W_]+)*", asked)
    if len(mine) <= 1 and word and any(p != word and p.startswith(word) for p in [*parts, *theirs]):
        return "truncated"
    if len(mine) > 2 and not foreign(answer, "en"):
        return "copy" if tiled(mine, theirs) >= 0.9 * len(mine) and len(mine) > 0.5 * len(theirs) else "truncated" if Pushdown(answer).open or answer.rstrip()[-1:] in "-,(«" else "wrong_language"
    return "wrong_language"


def type_defect(answer: str, question: str) -> str | None:
    """Of ``pun_type``: homographic or homophonic."""
    kind = unicodedata.normalize("NFKC", answer).strip().rstrip(".").strip().strip("\"'«»“”‘’ ").casefold()
    if kind in TYPES:
        return None
    if is_copy(tokens(answer), tokens(question)):
        return "copy"
    if kind and any(t.startswith(kind.rstrip("-….")) for t in TYPES) and kind.rstrip("-…."):
        return "truncated"
    plain = "".join(c for c in unicodedata.normalize("NFD", kind) if not unicodedata.combining(c))
    if FOREIGN_TYPE.match(plain) or foreign(answer, "en") or len(kind.split()) == 1:
        return "wrong_language"
    return "truncated" if Pushdown(answer).open else "wrong_language"


def pun_defect(answer: str, question: str) -> str | None:
    """Of ``generated_pun``: a complete French pun."""
    if is_copy(tokens(answer), tokens(question)):
        return "copy"
    if foreign(answer, "fr"):
        return "wrong_language"
    return "truncated" if breaks_off(answer) else None


CHECKS = {"pun_word": word_defect, "pun_type": type_defect, "generated_pun": pun_defect}


def defect(field: str, answer: str | None, question: str | None) -> str | None:
    if empty(answer):
        return "empty"
    if refuses(answer):
        return "refusal"
    return CHECKS[field](answer, question or "")


def defective_answers(df: DataFrame, key: str = "pair_id", question: str = "text_clean", fields: tuple[str, ...] = ("pun_word", "pun_type", "generated_pun")) -> DataFrame:
    """``key``, ``field_name``, ``defect``: one row per defective answer; no shuffle."""
    carry, way, kind = carried(df, key)
    source = spread(df.select(carry.alias("k"), F.col(question).cast("string").alias("q"), *(F.col(f).cast("string").alias(f) for f in fields)))

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.to_dict("records"):
                q = r["q"] if isinstance(r["q"], str) else None
                for f in fields:
                    found = defect(f, r[f] if isinstance(r[f], str) else None, q)
                    if found:
                        rows.append((r["k"], f, found))
            out = pd.DataFrame(rows, columns=["k", "field_name", "defect"])
            yield out.astype({"k": b["k"].dtype})

    return source.mapInPandas(frames(check), f"k {way}, field_name string, defect string").select(F.col("k").cast(kind).alias(key), "field_name", "defect")
