"""Statistics of each document's text, and what kind of text it is.

Statistics: words, mean word length, symbol ratio, share of lines that end in
punctuation, share of common words, share of duplicate lines and paragraphs, characters
covered by the most frequent word n-gram, shares of characters in sentences, list items
and table rows, of markup and of damaged characters.

Rules combine them into *prose*, *list*, *table* or *junk*. Dialogue counts as prose.
Everything is worked out row by row from the whole text; only the common words (a fixed
table) are sent along.

Defined cases: null, empty and blank texts have statistics of zero and no kind; lines
end at ``\\n``, ``\\r\\n`` or ``\\r``; a text of any length is read whole; repeated rows
repeat; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calembour.operators.layout import carried, frames, spread

WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
BULLET = re.compile(r"\s*(?:[-*•·–—▪◦+]\s+|\[[ xX✓]?\]\s*|\(?(?:\d{1,3}|[a-zA-Z]|[ivxlIVXL]{1,5})[.)]\s+)")
GRID = re.compile(r"\s*[+|]?[\s\-=+|:]{4,}\s*$")
ENDS, CLOSERS = frozenset(".!?…。！？"), "\"'”»’)]*_"
SENTENCE = re.compile(r"[^.!?…。！？]*[.!?…。！？]+[\"'”»’)\]]*")
TAG = re.compile(r"<[/!]?[A-Za-z][^<>]*>")
NUMBER = re.compile(r"(?<!\S)(?:(?=\S*\d)[0-9a-fA-F]{5,}|\d{4,})(?!\S)")
LONG = re.compile(r"\S{41,}")
HEX = re.compile(r"^(?=.*\d)[0-9a-fA-F]{5,}$|^\d{4,}$")
DAMAGE = re.compile("�|[ÃÂâÅ][\u0080-¿€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ©®§¤¬¨¹ª´]|[\u0080-\u009f]")
CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
#: n-grams of this many words are looked at for repetition
GRAM = 4

STATISTICS = {
    "n_words": "bigint",
    "n_sentences": "bigint",
    "n_items": "bigint",
    "mean_word_length": "double",
    "symbol_ratio": "double",
    "punctuated_lines": "double",
    "common_words": "double",
    "duplicate_lines": "double",
    "duplicate_paragraphs": "double",
    "duplicate_sentences": "double",
    "top_gram_coverage": "double",
    "sentence_share": "double",
    "item_share": "double",
    "table_share": "double",
    "markup_share": "double",
    "damage_share": "double",
    "distinct_words": "double",
    "odd_tokens": "double",
}


def ends_sentence(text: str) -> bool:
    """Whether a text without blanks at its end ends a sentence, quotes and brackets behind it aside."""
    return text.rstrip(CLOSERS)[-1:] in ENDS


def cells(line: str) -> tuple[str, int]:
    """The separator of a table row and its number of cells; ('', 0) if it looks like none."""
    s = line.strip()
    if s[:1] == "|" and s.count("|") > 2:
        return "|", s.count("|") - 1
    if s[:1] == '"' and s[-1:] == '"' and s.count('","') > 1:
        return '","', s.count('","') + 1
    if line.count("\t") > 1:
        return "\t", line.count("\t") + 1
    if line.count(";") > 1 and "; " not in line.strip(";"):
        return ";", line.count(";") + 1
    wide = re.split(r"\s{2,}", s)
    if len(wide) > 2 and not ends_sentence(s):
        return "  ", len(wide)
    if line.count(" | ") > 1:
        return " | ", line.count(" | ") + 1
    if line.count(",") > 1 and ", " not in line:
        return ",", line.count(",") + 1
    return "", 0


def table_rows(lines: list[str]) -> list[bool]:
    """Which lines are rows of a table: three or more cells, like their neighbours."""
    shapes = [cells(x) for x in lines]
    usual = Counter(s for s in shapes if s[1] > 2)
    kinds = Counter(s[0] for s in shapes if s[1] > 2)
    out = []
    for x, (sep, n) in zip(lines, shapes, strict=True):
        same = usual[sep, n] > 1 or (sep in ("|", '","', "  ", "\t") and kinds[sep] > 1)
        out.append((n > 2 and same) or bool(GRID.match(x) and len(x.strip()) > 3))
    if any(out):
        return [o or bool(GRID.match(x)) for o, x in zip(out, lines, strict=True)]
    return out


def is_item(line: str) -> bool:
    """A list item that is no sentence: short, without the end of a sentence."""
    m = BULLET.match(line)
    body = line[m.end() :].strip() if m else line.strip()
    words = WORD.findall(body)
    if not body or not words and not any(c.isdigit() for c in body):
        return bool(m)
    if ends_sentence(body) and len(words) > 3:
        return False
    return len(words) <= (10 if m else 6)


def run_together(text: str) -> int:
    """The number of short items on one line between separators; 0 if that is not what the line is."""
    for sep in (" · ", " • ", " | ", " / ", "; ", ", "):
        if text.count(sep.strip()) >= 3:
            parts = [p.strip() for p in text.split(sep.strip())]
            sizes = [len(p.split()) for p in parts]
            if sum(sizes) / len(sizes) <= 4.5 and max(sizes) <= 9 and not re.search(r"[.!?…]\s+\w", text):
                return len(parts)
    return 0


class Letters(dict):
    """Translation table that leaves letters and digits only."""

    def __missing__(self, code: int) -> int | None:
        kept = self[code] = code if chr(code).isalnum() else None
        return kept


LETTERS_ONLY = Letters()


class Layout:
    """Lines of a text, which of them are table rows, and how the rest falls into sentences and list items."""

    def __init__(self, text: str):
        self.text = text.replace("\r\n", "\n").replace("\r", "\n")
        lines = self.lines = [x for x in self.text.split("\n") if x.strip()]
        self.size = sum(len(x.strip()) for x in lines)
        rows = table_rows(lines)
        self.row_chars = sum(len(x.strip()) for x, r in zip(lines, rows, strict=True) if r)
        # hard-wrapped lines belong together: a line that is long or does not end a sentence runs on
        blocks: list[str] = []
        items = n_items = 0
        flow = ""
        width = max(map(len, lines))
        for k, (x, r) in enumerate(zip(lines, rows, strict=True)):
            s = x.strip()
            before_full = k and width > 50 and len(lines[k - 1]) >= 0.72 * width and not ends_sentence(lines[k - 1].strip())
            if r:
                flow = flow and (blocks.append(flow) or "")
            elif not (flow and before_full) and (is_item(x) or (not ends_sentence(s) and run_together(s))):
                flow = flow and (blocks.append(flow) or "")
                items += len(s)
                n_items += run_together(s) or 1
            elif not flow and BULLET.match(x):
                blocks.append(BULLET.sub("", x, count=1).strip())
            else:
                flow = f"{flow} {s}" if flow else s
        if flow:
            blocks.append(flow)
        self.sentences: list[str] = []
        self.in_sentences = 0
        for b in blocks:
            # without this bound a search for the end of a sentence would run to the end of the block from every character
            last = max(map(b.rfind, ENDS)) + 1
            if not last and (parts := run_together(re.sub(r"^[^:]{0,40}:\s*", "", b))):
                items += len(b)
                n_items += parts
                continue
            while 0 < last < len(b) and b[last] in CLOSERS:
                last += 1
            for m in SENTENCE.findall(b[:last]) if last else ():
                if next(islice(WORD.finditer(m), 2, None), None) or (cjk := len(CJK.findall(m))) > 6 or (cjk > 4 and WORD.search(m)):
                    self.sentences.append(m.strip())
                    self.in_sentences += len(m.strip())
        self.items, self.n_items = items, n_items

    def sentence_share(self) -> float:
        return min(1.0, self.in_sentences / max(1, self.size))


def doubled(parts: list[str]) -> float:
    """Share of ``parts`` that repeat an earlier one."""
    return 1 - len(set(parts)) / len(parts) if parts else 0.0


def odd_tokens(text: str) -> int:
    """The number of tokens that are numbers, hashes or other long runs that nobody reads."""
    return len(NUMBER.findall(text)) + sum(k.isascii() and k.count("-") < 3 and not re.search(r"[;,|]", k) and not HEX.match(k) for k in LONG.findall(text))


def top_gram(words: list[str]) -> tuple[tuple[str, ...], int]:
    """The most frequent run of GRAM words (among equals the one with the longest first word) and how often it occurs, if more than once."""
    grams = Counter(zip(*(words[i:] for i in range(GRAM)), strict=False))
    times = max(grams.values(), default=0)
    if times < 2:
        return (), times
    return max((g for g, n in grams.items() if n == times), key=lambda g: len(g[0])), times


def statistics(text: str | None, common: frozenset[str]) -> dict[str, float]:
    zero = dict.fromkeys(STATISTICS, 0.0) | {"n_words": 0, "n_sentences": 0, "n_items": 0}
    if text is None or not text.strip():
        return zero
    laid = Layout(text)
    t, lines, size = laid.text, laid.lines, max(1, laid.size)
    words = WORD.findall(t)
    lower = "\n".join(words).casefold().replace("’", "'").split("\n") if words else []
    tokens = t.split()
    visible = sum(map(len, tokens))
    letters = len(t.translate(LETTERS_ONLY))
    word_letters = sum(map(len, words))
    tags = sum(map(len, TAG.findall(t))) if "<" in t else 0
    paragraphs = [p.strip() for p in re.split(r"\n\s*\n", t) if p.strip()]
    gram, times = top_gram(lower)
    return {
        "n_words": len(words),
        "n_sentences": len(laid.sentences),
        "n_items": laid.n_items,
        "mean_word_length": word_letters / len(words) if words else 0.0,
        "symbol_ratio": 1 - letters / visible if visible else 0.0,
        "punctuated_lines": sum(ends_sentence(x.strip()) for x in lines) / len(lines),
        "common_words": sum(w in common or ("'" in w and w.split("'")[0] in common) for w in lower) / len(lower) if lower else 0.0,
        "duplicate_lines": doubled([x.strip() for x in lines]),
        "duplicate_paragraphs": doubled(paragraphs),
        "duplicate_sentences": doubled(laid.sentences),
        "top_gram_coverage": min(1.0, times * sum(map(len, gram)) / max(1, word_letters)) if times > 1 else 0.0,
        "sentence_share": laid.sentence_share(),
        "item_share": laid.items / size,
        "table_share": laid.row_chars / size,
        "markup_share": tags / size,
        "damage_share": 0.0 if t.isascii() else len(DAMAGE.findall(t)) / max(1, len(tokens)),
        "distinct_words": len(set(lower)) / len(lower) if lower else 0.0,
        "odd_tokens": odd_tokens(t) / max(1, len(tokens)),
    }


def kind_of(text: str | None, s: dict[str, float]) -> str | None:
    """The combined rules."""
    if text is None or not text.strip():
        return None
    if s["markup_share"] > 0.4 or s["damage_share"] > 0.08 or s["odd_tokens"] > 0.5:
        return "junk"
    if s["table_share"] >= 0.5:
        return "table"
    if s["symbol_ratio"] > 0.45 or not s["n_words"] and not CJK.search(text):
        return "junk"
    if s["duplicate_sentences"] > 0.8 or (s["top_gram_coverage"] > 0.6 and s["n_words"] > 12):
        return "junk"
    if s["n_items"] > 3 * s["n_sentences"] and s["item_share"] >= 0.3:
        return "list"
    if s["sentence_share"] >= 0.5:
        return "prose"
    if s["item_share"] >= 0.5:
        return "list"
    if s["sentence_share"] + s["item_share"] + s["table_share"] > 0.6:
        return max((("prose", s["sentence_share"]), ("list", s["item_share"]), ("table", s["table_share"])), key=lambda x: x[1])[0]
    return "junk"


def quality(df: DataFrame, common_words: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, the statistics and ``kind`` of every document. One pass, no shuffle.

    ``common_words`` is a fixed table (a list of the commonest words of each language).
    """
    common = frozenset(r["word"].casefold() for r in common_words.select("word").where("word IS NOT NULL").distinct().toLocalIterator())
    carry, way, own = carried(df, key)
    source = spread(df.select(carry.alias("k"), F.col(text).cast("string").alias("t")))
    schema = f"k {way}, " + ", ".join(f"{n} {t}" for n, t in STATISTICS.items()) + ", kind string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t in b["t"]:
                t = t if isinstance(t, str) else None
                s = statistics(t, common)
                rows.append({**s, "kind": kind_of(t, s)})
            out = pd.DataFrame(rows, columns=[*STATISTICS, "kind"])
            out.insert(0, "k", b["k"].to_numpy())
            yield out

    return source.mapInPandas(frames(run), schema).select(F.col("k").cast(own).alias(key), *STATISTICS, "kind")


def not_prose(df: DataFrame, common_words: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``kind`` of each document that isn't mainly natural prose."""
    return quality(df, common_words, key, text).where("kind <> 'prose'").select(key, "kind")
