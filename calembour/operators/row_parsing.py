"""Raw delimited lines into typed records, the unreadable ones apart with reason and offset.

Semantics of ``parse_records``:

* A record has seven comma-separated fields. A whole field may stand in double quotes
  and then may hold commas, line breaks and doubled double quotes; a double quote
  anywhere else, text after a closing quote, or an unclosed quote is ``quoting``.
* Not seven fields: ``column_count`` (a null or empty line has none or one field).
* A field against its type: ``value`` (``id_en`` is ``en_`` and digits, ``pun_word`` not
  blank, ``pun_type`` homographic or homophonic in any case with blanks around,
  ``chunk`` digits, the three others bracketed lists of quoted strings).
* The first reason in that order holds. ``error_offset`` is the character position of
  the offending character: the stray or unclosed quote, the end of the line for a
  wrong count, the start of the offending field for a value.

Repeated lines each give a row; an empty table gives an empty one; other columns of
the input are neither needed nor returned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calembour.functions.automata import Automaton, lay_out
from calembour.operators.layout import carried, frames, spread

FIELDS = ("id_en", "pun_word", "pun_type", "first_meaning", "second_meaning", "first_context", "chunk")
LIST_FIELDS = (3, 4, 5)

# states: 0 field start, 1 in a bare field, 2 in quotes, 3 a quote seen in quotes, 4 error
OPEN, BARE, QUOTED, CLOSING, BROKEN = range(5)
RECORD = Automaton(
    {'"': 2, ",": 3},
    [
        [BARE, BARE, QUOTED, BROKEN, BROKEN],  # any other character
        [OPEN, OPEN, OPEN, OPEN, OPEN],  # end of line
        [QUOTED, BROKEN, CLOSING, QUOTED, BROKEN],  # "
        [OPEN, OPEN, QUOTED, OPEN, BROKEN],  # ,
    ],
)

# states: 0 before [, 1 after [, 2 in '..', 3 escape in '..', 4 in "..", 5 escape in "..", 6 after a string, 7 after a comma, 8 after ], 9 error
E9 = 9
LIST = Automaton(
    {"[": 2, "]": 3, ",": 4, "'": 5, '"': 6, "\\": 7, " ": 8, "\t": 8, "\n": 8, "\r": 8, " ": 8},
    [
        # 0   1   2  3  4  5  6   7   8   9
        [E9, E9, 2, 2, 4, 4, E9, E9, E9, E9],  # any other character
        [0, 0, 0, 0, 0, 0, 0, 0, 0, 0],  # end
        [1, E9, 2, 2, 4, 4, E9, E9, E9, E9],  # [
        [E9, 8, 2, 2, 4, 4, 8, E9, E9, E9],  # ]
        [E9, E9, 2, 2, 4, 4, 7, E9, E9, E9],  # ,
        [E9, 2, 6, 2, 4, 4, E9, 2, E9, E9],  # '
        [E9, 4, 2, 2, 6, 4, E9, 4, E9, E9],  # "
        [E9, E9, 3, 2, 5, 4, E9, E9, E9, E9],  # backslash
        [0, 1, 2, 2, 4, 4, 6, 7, 8, E9],  # blank or line break
    ],
)
LIST_END = 8

ID = re.compile(r"en_[0-9]+")
DIGITS = re.compile(r"[0-9]+")
TYPES = ("homographic", "homophonic")
ITEM = re.compile(r"'((?:[^'\\]|\\.)*)'|\"((?:[^\"\\]|\\.)*)\"", re.DOTALL)
ESCAPE = re.compile(r"\\(.)", re.DOTALL)
ESCAPED = {"n": "\n", "t": "\t", "r": "\r"}

RESULT = (
    "id_en string, pun_word string, pun_type string, first_meaning array<string>, second_meaning array<string>, "
    "first_context array<string>, chunk bigint, reason string, error_offset int"
)


def list_items(text: str) -> list[str]:
    """The strings of a list that ``LIST`` accepted."""
    return [ESCAPE.sub(lambda m: ESCAPED.get(m[1], m[1]), a or b) for a, b in ITEM.findall(text)]


def lists_ok(texts: list[str]) -> np.ndarray:
    """For each text whether it is a bracketed list of quoted strings."""
    if not texts:
        return np.zeros(0, dtype=bool)
    codes, _, ends = lay_out(texts)
    cls = LIST.classify(codes)
    cls[ends] = 1
    return LIST.run(cls)[ends] == LIST_END


def tokenize(lines: list[str]) -> tuple[list[list[str] | None], np.ndarray, np.ndarray]:
    """Fields of each line (None where quoting is broken), the offset of the first quoting error, the field starts' flat array."""
    codes, starts, ends = lay_out(lines)
    cls = RECORD.classify(codes)
    cls[ends] = 1
    before = RECORD.run(cls)
    after = np.empty_like(before)
    after[:-1], after[-1:] = before[1:], OPEN
    after[ends] = OPEN
    # the first step into the error state, by line
    owner = np.searchsorted(ends, np.flatnonzero((after == BROKEN) & (before != BROKEN)))
    bad = np.full(len(lines), -1, dtype=np.int64)
    bad[owner] = np.flatnonzero((after == BROKEN) & (before != BROKEN)) - starts[owner]
    # quotes still open at the end: the offset is that of the opening quote
    for i in np.flatnonzero((before[ends] == QUOTED) & (bad < 0)):
        opening = np.flatnonzero((cls[starts[i] : ends[i]] == 2) & (before[starts[i] : ends[i]] == OPEN))
        bad[i] = opening[-1] if len(opening) else 0
    commas = np.flatnonzero((cls == 3) & (before != QUOTED) & (before != BROKEN))
    first = np.searchsorted(commas, starts)
    last = np.searchsorted(commas, ends)
    fields: list[list[str] | None] = []
    for i, line in enumerate(lines):
        if bad[i] >= 0:
            fields.append(None)
            continue
        cuts = (commas[first[i] : last[i]] - starts[i]).tolist()
        parts = [line[a:b] for a, b in zip([0, *(c + 1 for c in cuts)], [*cuts, len(line)], strict=True)]
        fields.append([p[1:-1].replace('""', '"') if p[:1] == '"' else p for p in parts])
    return fields, bad, last - first + 1


def parse_batch(lines: list[str | None]) -> pd.DataFrame:
    fields, bad, _ = tokenize([x or "" for x in lines])
    raw = [x or "" for x in lines]
    lists = [(i, k) for i, f in enumerate(fields) if f is not None and len(f) == len(FIELDS) for k in LIST_FIELDS]
    good = dict(zip(lists, lists_ok([fields[i][k] for i, k in lists]).tolist(), strict=True))
    rows = []
    for i, f in enumerate(fields):
        if f is None:
            rows.append((*[None] * 7, "quoting", int(bad[i])))
        elif lines[i] is None or len(f) != len(FIELDS):
            rows.append((*[None] * 7, "column_count", len(raw[i])))
        else:
            kind = f[2].strip().lower()
            checks = (ID.fullmatch(f[0]), f[1].strip(), kind in TYPES, good[i, 3], good[i, 4], good[i, 5], DIGITS.fullmatch(f[6]) and len(f[6].lstrip("0")) < 19)
            wrong = next((k for k, ok in enumerate(checks) if not ok), None)
            # digits beyond a BIGINT are still digits: such a chunk number is valid but has no typed value
            if wrong == 6 and DIGITS.fullmatch(f[6]):
                wrong = None
            if wrong is not None:
                at, k = 0, 0
                quoted = False
                for at, ch in enumerate(raw[i]):
                    if k == wrong:
                        break
                    quoted ^= ch == '"'
                    k += ch == "," and not quoted
                else:
                    at = len(raw[i])
                rows.append((*[None] * 7, "value", at))
            else:
                chunk = int(f[6]) if len(f[6].lstrip("0")) < 19 else None
                rows.append((f[0], f[1].strip(), kind, *(list_items(f[k]) for k in LIST_FIELDS), chunk, None, None))
    out = pd.DataFrame(rows, columns=[*FIELDS, "reason", "error_offset"], dtype=object)
    return out


def parse_records(df: DataFrame, key: str = "line_id", line: str = "line") -> DataFrame:
    """``key``, the seven typed fields, ``reason`` and ``error_offset``; one row per input row, no shuffle."""
    carry, way, kind = carried(df, key)
    source = spread(df.select(carry.alias("k"), F.col(line).cast("string").alias("line")))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = parse_batch([None if x is None or x is pd.NA else x for x in b["line"].tolist()])
            out.insert(0, "k", b["k"].to_numpy())
            yield out

    return source.mapInPandas(frames(parse), f"k {way}, {RESULT}").select(F.col("k").cast(kind).alias(key), *FIELDS, "reason", "error_offset")


def good_records(df: DataFrame, key: str = "line_id", line: str = "line") -> DataFrame:
    """The valid lines as typed records."""
    return parse_records(df, key, line).where("reason IS NULL").drop("reason", "error_offset")


def bad_records(df: DataFrame, key: str = "line_id", line: str = "line") -> DataFrame:
    """The other lines: ``key``, ``reason``, ``error_offset``."""
    return parse_records(df, key, line).where("reason IS NOT NULL").select(key, "reason", "error_offset")
