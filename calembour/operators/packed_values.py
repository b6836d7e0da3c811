"""Fields that hold several values, split into one row per value with its position.

A field is scanned once: brackets, list marks and quotes are recognised where an item
begins; what quotes enclose is one value, escapes inside them are resolved. Unquoted
stretches are cut by dictionary-guided segmentation: a multi-pattern automaton finds
every known whole value that lies between cut points, and dynamic programming picks
the cover of the stretch with the fewest unknown pieces, so a separator inside a known
value does not cut it.

The dictionary is learnt from the same table: values that are written in quotes at least
``MIN_SUPPORT`` times, however large the table. Up to ``MOST_SENT`` characters it is
sent to every task; a larger one is joined with the runs of pieces that occur in
unquoted stretches, and each text gets the values known in it. Both ways give the same.

Defined cases: null, blank, empty brackets and separators alone give no row; empty
items do not count; repeated rows repeat; fields of any length are scanned whole;
other columns are ignored.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calembour.operators.layout import carried, frames, spread
from calembour.operators.skew import salted_join
from calembour.session import checkpointed

MIN_SUPPORT = 2
MOST_SENT = 8_000_000

SEPARATORS = ",;|/\t\n\r·•、‧;，；｜"
BULLETS = "-*•·–—▪◦‣"
CLOSING = {'"': '"', "“": "”", "«": "»", "'": "'", "‘": "’", "„": "“", "「": "」"}
MARK = re.compile(r"(?:[-*•·–—▪◦‣][^\S\n]+|\(\d{1,3}\)\s*|\d{1,3}[.)](?=\s|$)\s*)")
INNER_MARK = re.compile(r"\s(?:\(\d{1,3}\)|\d{1,3}[.)])\s")
HAS_SEPARATOR = re.compile("[" + re.escape(SEPARATORS) + "]")
#: Where an unquoted stretch can be cut or end; anything else is passed over.
TURN = re.compile("[\\s«“" + re.escape(SEPARATORS) + "]")
QUOTE = re.compile("[" + re.escape("".join(CLOSING)) + "]")
ESCAPE = re.compile(r"\\(u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|.)", re.DOTALL)
ESCAPED = {"n": "\n", "t": "\t", "r": "\r"}


def unescape(text: str, quote: str) -> str:
    def one(m: re.Match) -> str:
        x = m[1]
        return chr(int(x[1:], 16)) if len(x) > 1 else ESCAPED.get(x, x)

    return ESCAPE.sub(one, text.replace(quote * 2, quote) if quote == '"' else text)


def closing_at(text: str, start: int, end: int) -> int:
    """Index of the quote that closes the one at ``start``: what follows it must end the item. -1: none."""
    quote, shut = text[start], CLOSING[text[start]]
    i = start + 1
    while i < end:
        ch = text[i]
        if ch == "\\" and i + 1 < end:
            i += 2
            continue
        if ch == shut:
            if quote == '"' and i + 1 < end and text[i + 1] == '"' and not (i == start + 1 and (i + 2 >= end or text[i + 2] in SEPARATORS)):
                i += 2
                continue
            j = i + 1
            while j < end and text[j] in "   ":
                j += 1
            if j >= end or text[j] in SEPARATORS or text[j] == "]" or (text[j] in CLOSING and text[j] != "'" and j > i) or (j > i + 1 and MARK.match(text, j)):
                return i
        i += 1
    return -1


class Dictionary:
    """Known whole values, in an automaton."""

    def __init__(self, values: list[str]):
        import ahocorasick

        self.size = len(values)
        self.automaton = ahocorasick.Automaton()
        for v in values:
            self.automaton.add_word(v, len(v))
        if values:
            self.automaton.make_automaton()

    def spans(self, text: str) -> list[tuple[int, int]]:
        return [(e + 1 - n, e + 1) for e, n in self.automaton.iter(text)] if self.size else []

    def runs(self, text: str, pieces: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """(first, last) of the runs of ``pieces`` that are a known value."""
        spans = self.spans(text)
        if not spans:
            return []
        starts = {a: i for i, (a, b) in enumerate(pieces) if b > a}
        ends = {b: i for i, (a, b) in enumerate(pieces) if b > a}
        return [(starts[a], ends[b]) for a, b in spans if a in starts and b in ends and ends[b] >= starts[a]]


class Runs:
    """Gathers the runs of pieces that could be a known value, of at most so many pieces and characters."""

    def __init__(self, pieces: int, letters: int):
        self.pieces, self.letters, self.seen = pieces, letters, set()

    def runs(self, text: str, pieces: list[tuple[int, int]]) -> list[tuple[int, int]]:
        if len(pieces) > 1:
            full = [(a, b) for a, b in pieces if b > a]
            for i, (a, _) in enumerate(full):
                for _, b in full[i : i + self.pieces]:
                    if b - a > self.letters:
                        break
                    self.seen.add(text[a:b])
        return []


def cover(text: str, cuts: list[tuple[int, int]], known: Dictionary | Runs) -> list[str]:
    """Pieces of ``text`` between separators (``cuts``: their start and end), some joined again because their whole is known.

    Cost: 5 for an unknown piece, 2 for a known value however many separators it
    spans; ties go to the finer cover.
    """
    pieces, at = [], 0
    for a, b in [*cuts, (len(text), len(text))]:
        pieces.append((at, a))
        at = b
    trimmed = []
    for a, b in pieces:
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        trimmed.append((a, b))
    joins = known.runs(text, trimmed)
    if any(j > i for i, j in joins):
        n = len(trimmed)
        cost, back = [0] + [5 * n + 1] * n, [0] * (n + 1)
        by_end: dict[int, list[int]] = {}
        for i, j in joins:
            by_end.setdefault(j, []).append(i)
        for j in range(n):
            a, b = trimmed[j]
            cost[j + 1], back[j + 1] = cost[j] + 5 * (b > a), j
            for i in by_end.get(j, ()):
                if cost[i] + 2 < cost[j + 1]:
                    cost[j + 1], back[j + 1] = cost[i] + 2, i
        out, j = [], n
        while j:
            out.append((trimmed[back[j]][0], trimmed[j - 1][1]))
            j = back[j]
        trimmed = out[::-1]
    return [text[a:b] for a, b in trimmed if b > a]


def literal_list(text: str) -> list[str] | None:
    for read in (json.loads, ast.literal_eval):
        try:
            got = read(text)
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            continue
        if isinstance(got, (list, tuple)) and all(isinstance(x, str) or x is None for x in got):
            return [x for x in got if x is not None]
    return None


def scan(text: str, known: Dictionary | Runs) -> list[tuple[str, bool]]:
    """(value, was it quoted) of the items of a field, empty ones included."""
    t = text.strip()
    if t[:1] == "[" and t[-1:] == "]":
        got = literal_list(t)
        if got is not None:
            return [(x, True) for x in got]
        t = t[1:-1].strip()
    out: list[tuple[str, bool]] = []
    i, n = 0, len(t)
    open_ended: set[str] = set()

    def closed(at: int) -> int:
        """``closing_at``; a kind of quote that once had no end has none further on, so a text is not searched again and again."""
        quote = t[at]
        if quote in open_ended and t[at + 1 : at + 2] != quote:
            return -1
        end = closing_at(t, at, n)
        if end < 0:
            open_ended.add(quote)
        return end

    while i < n:
        while i < n and (t[i].isspace() or t[i] in SEPARATORS) and not MARK.match(t, i):
            i += 1
        m = MARK.match(t, i)
        if m:
            i = m.end()
            continue
        if i >= n:
            break
        if t[i] in CLOSING and (end := closed(i)) > i:
            out.append((unescape(t[i + 1 : end], t[i]), True))
            i = end + 1
            continue
        # an unquoted stretch reaches to the next item that begins with a quote, or the end
        cuts, j, start = [], i, i
        while j < n:
            turn = TURN.search(t, j)
            if not turn:
                j = n
                break
            j = turn.start()
            m = INNER_MARK.match(t, j)
            if m:
                cuts.append((j - start, m.end() - start))
                j = m.end()
            elif t[j] in SEPARATORS:
                k = j + 1
                while k < n and (t[k].isspace() or t[k] in SEPARATORS):
                    k += 1
                m = MARK.match(t, k)
                if m and (t[j] not in BULLETS):
                    k = m.end()
                cuts.append((j - start, k - start))
                j = k
                if j < n and t[j] in CLOSING and closed(j) > j:
                    break
            elif t[j] in "«“" and j > start and t[j - 1].isspace() and closed(j) > j:
                break
            else:
                j += 1
        out.extend((v, False) for v in cover(t[start:j], cuts, known))
        i = j
    return out


def split_values(text: str | None, known: Dictionary) -> list[str]:
    if text is None or not text.strip():
        return []
    return [v for v in (x.strip() for x, _ in scan(text, known)) if v]


def _quoted_values(df: DataFrame, fields: list[str]) -> DataFrame:
    """``value``: the dictionary, over all rows of ``fields``."""

    def quoted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none = Dictionary([])
        for b in batches:
            found: dict[str, int] = {}
            for f in fields:
                for t in b[f].dropna():
                    if not QUOTE.search(t):
                        continue
                    for v, q in scan(t, none):
                        if q and (v := v.strip()):
                            found[v] = found.get(v, 0) + 1
            yield pd.DataFrame({"value": list(found), "n": list(found.values())})

    source = spread(df.select(*(F.col(f).cast("string").alias(f) for f in fields)))
    counts = source.mapInPandas(frames(quoted), "value string, n bigint").groupBy("value").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= MIN_SUPPORT).select("value")


def known_values(df: DataFrame, fields: list[str]) -> list[str]:
    """The dictionary as a list, for tables whose dictionary fits the driver."""
    return [r["value"] for r in _quoted_values(df, fields).toLocalIterator()]


def _schema(kind: str) -> str:
    return f"k {kind}, field_name string, pos int, value string"


def unpack_values(df: DataFrame, key: str, fields: list[str], dictionary: list[str] | None = None) -> DataFrame:
    """``key``, ``field_name``, ``pos`` (from 1), ``value``: one row per value. No shuffle beyond learning the dictionary, unless it is too large to be sent."""
    values = dictionary
    if values is None:
        learnt = checkpointed(_quoted_values(df, fields))
        if (learnt.agg(F.sum(F.length("value")).alias("n")).first()["n"] or 0) > MOST_SENT:
            return _unpack_joined(df, key, fields, learnt)
        values = [r["value"] for r in learnt.toLocalIterator()]
    carry, way, kind = carried(df, key)
    source = spread(df.select(carry.alias("k"), *(F.col(f).cast("string").alias(f) for f in fields)))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Dictionary(values)
        for b in batches:
            keys, names, places, found = [], [], [], []
            for f in fields:
                for k, t in zip(b["k"], b[f], strict=True):
                    for p, v in enumerate(split_values(t, known), 1):
                        keys.append(k)
                        names.append(f)
                        places.append(p)
                        found.append(v)
            yield pd.DataFrame({"k": pd.Series(keys, dtype=b["k"].dtype), "field_name": names, "pos": pd.Series(places, dtype="int32"), "value": found})

    return source.mapInPandas(frames(split), _schema(way)).select(F.col("k").cast(kind).alias(key), "field_name", "pos", "value")


def _unpack_joined(df: DataFrame, key: str, fields: list[str], learnt: DataFrame) -> DataFrame:
    """``unpack_values`` with a dictionary of any size: each distinct text gets the known values among its runs of pieces."""
    stacked = F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.col(f).cast("string").alias("t")) for f in fields))).alias("x")
    carry, way, kind = carried(df, key)
    rows = df.select(carry.alias("k"), stacked).select("k", "x.f", "x.t").where("t IS NOT NULL")
    rows = checkpointed(rows.withColumns({"h1": F.xxhash64("t"), "h2": F.xxhash64(F.lit("b"), "t")}))
    texts = rows.groupBy("h1", "h2").agg(F.first("t").alias("t"), F.count(F.lit(1)).alias("n"))
    # a value has at most one piece more than it has separators and blanks
    most = learnt.agg(F.max(F.length(F.regexp_replace("value", f"[^\\s{re.escape(SEPARATORS)}]", ""))).alias("cuts"), F.max(F.length("value")).alias("letters")).first()
    pieces, letters = most["cuts"] + 1, most["letters"]

    def candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for h1, h2, t in zip(b["h1"], b["h2"], b["t"], strict=True):
                gather = Runs(pieces, letters)
                scan(t, gather)
                out += [(h1, h2, v) for v in gather.seen]
            yield pd.DataFrame(out, columns=["h1", "h2", "value"])

    met = texts.select("h1", "h2", "t").mapInPandas(frames(candidates), "h1 bigint, h2 bigint, value string").join(learnt, "value")
    counts = checkpointed(texts.drop("t"))
    known = met.groupBy("h1", "h2").agg(F.collect_list("value").alias("known")).join(counts, ["h1", "h2"])
    both = salted_join(rows, known, ["h1", "h2"], "n", max(1, rows.count()), F.col("k"), how="left", counts=counts)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none = Dictionary([])
        for b in batches:
            keys, names, places, found = [], [], [], []
            for k, f, t, own in zip(b["k"], b["f"], b["t"], b["known"], strict=True):
                for p, v in enumerate(split_values(t, none if own is None else Dictionary(list(own))), 1):
                    keys.append(k)
                    names.append(f)
                    places.append(p)
                    found.append(v)
            yield pd.DataFrame({"k": pd.Series(keys, dtype=b["k"].dtype), "field_name": names, "pos": pd.Series(places, dtype="int32"), "value": found})

    return both.select("k", "f", "t", "known").mapInPandas(frames(split), _schema(way)).select(F.col("k").cast(kind).alias(key), "field_name", "pos", "value")
