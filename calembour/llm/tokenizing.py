"""Encoding a corpus with a public byte-level BPE vocabulary, by speculation and verification.

A word is first cut greedily into the longest tokens. Such a cut equals the result of
the merges exactly when each token is what the merges make of its own bytes and each
adjacent pair is *compatible*: no merge of lower rank would have joined bytes across
the boundary. All pairs of a batch are tested together in numpy; only words with a
failing pair are merged step by step.

The vocabulary file (``byte_bpe_50k.json``: vocabulary and merges) is read by each
worker from ``path``, a parameter; nothing of it is stored here.

Defined cases: null and empty texts give an empty list; a text's special-token strings
are ordinary text; texts of any length are encoded whole; repeated rows repeat.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calembour.operators.layout import spread

BYTE_BPE_50K = "/opt/tokenizers/byte_bpe_50k.json"
#: How a byte-level BPE of this family cuts a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NO_LIMIT = np.int64(1) << 40
#: Words remembered by a worker before it starts afresh, so that its memory stays bounded.
REMEMBERED = 300_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte: itself if printable, else the next of U+0100, U+0101, ..."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte_of = byte_alphabet()
        raw = {bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items() if all(c in byte_of for c in t)}
        of = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        n = max(of.values()) + 1
        self.rank = np.full(n, -1, dtype=np.int64)  # merge rank that makes the token, -1: a single byte
        self.left, self.right = np.arange(n), np.arange(n)
        pairs = {}
        for rank, (a, b) in enumerate(merges):
            x, y, z = of[a], of[b], of[a + b]
            pairs[x, y] = (rank, z)
            if self.rank[z] < 0:
                self.rank[z], self.left[z], self.right[z] = rank, x, y
        self.merge = pairs
        keys = np.fromiter((x * n + y for x, y in pairs), dtype=np.int64, count=len(pairs))
        order = np.argsort(keys)
        self.keys, self.key_rank = keys[order], np.arange(len(keys), dtype=np.int64)[order]
        self.n = n
        own = self.rank >= 0
        sound = np.ones(n, dtype=bool)
        sound[own] = self.compatible(self.left[own], self.right[own], self.rank[own])
        # a token is reachable when its halves are and nothing merges across them earlier
        for t in np.argsort(self.rank):
            if self.rank[t] >= 0:
                sound[t] &= sound[self.left[t]] and sound[self.right[t]]
        self.ids = {t: i for t, i in raw.items() if sound[i]}
        self.bytes = {i: raw_id for raw_id, i in raw.items() if len(raw_id) == 1}
        self.single = [raw[bytes([b])] for b in range(256)]
        self.reach = np.zeros(65_536, dtype=np.int16)  # longest token by its first two bytes
        for t in self.ids:
            if len(t) > 1:
                k = t[0] << 8 | t[1]
                self.reach[k] = max(self.reach[k], len(t))
        self.reach = self.reach.tolist()
        self.known: dict[str, list[int]] = {}

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """For each pair of tokens whether the merges would leave the boundary between them alone.

        The later-made side is opened again and again at the boundary; a merge that joins
        what then faces each other and ranks below everything opened so far breaks the pair.
        """
        a, b = a.astype(np.int64).copy(), b.astype(np.int64).copy()
        good = np.ones(len(a), dtype=bool)
        limit = np.full(len(a), NO_LIMIT) if limit is None else limit.astype(np.int64).copy()
        live = np.arange(len(a))
        while len(live):
            key = a[live] * self.n + b[live]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = (self.keys[at] == key) & (self.key_rank[at] < limit[live])
            good[live[hit]] = False
            live = live[~hit]
            ra, rb = self.rank[a[live]], self.rank[b[live]]
            live_more = (ra >= 0) | (rb >= 0)
            live, ra, rb = live[live_more], ra[live_more], rb[live_more]
            open_a = ra > rb
            # a merge inside the left token comes before one of equal rank across the boundary, one inside the right token after it
            limit[live] = np.where(open_a, ra, rb + 1)
            a[live] = np.where(open_a, self.right[a[live]], a[live])
            b[live] = np.where(open_a, b[live], self.left[b[live]])
        return good

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        out, at, n, ids, reach = [], 0, len(word), self.ids, self.reach
        while at < n:
            most = min(reach[word[at] << 8 | word[at + 1]], n - at) if at + 1 < n else 1
            for size in range(most, 1, -1):
                t = ids.get(word[at : at + size])
                if t is not None:
                    out.append(t)
                    at += size
                    break
            else:
                out.append(self.single[word[at]])
                at += 1
        return out

    def merged(self, word: bytes) -> list[int]:
        """Exact merging: lowest rank first, leftmost among equals, over a linked list with a heap."""
        ids = [self.single[b] for b in word]
        n = len(ids)
        nxt, prv = [*range(1, n), -1], list(range(-1, n - 1))
        heap = []

        def offer(i: int) -> None:
            j = nxt[i]
            if j >= 0 and (m := self.merge.get((ids[i], ids[j]))):
                heap.append((m[0], i, ids[i], ids[j], m[1]))

        for i in range(n):
            offer(i)
        heapq.heapify(heap)
        while heap:
            _, i, x, y, z = heapq.heappop(heap)
            j = nxt[i] if ids[i] == x else -1
            if j < 0 or ids[j] != y:
                continue
            ids[i], ids[j] = z, -1
            nxt[i] = nxt[j]
            if nxt[i] >= 0:
                prv[nxt[i]] = i
            for k in (prv[i], i):
                if k >= 0:
                    size = len(heap)
                    offer(k)
                    if len(heap) > size:
                        heapq.heappush(heap, heap.pop())
        return [t for t in ids if t >= 0]

    def learn(self, words: set[str]) -> None:
        """Encode words not seen yet and remember them."""
        fresh = [w for w in words if w not in self.known]
        cuts = [self.propose(w.encode("utf-8", "replace")) for w in fresh]
        sizes = np.fromiter((len(c) for c in cuts), dtype=np.int64, count=len(cuts))
        flat = np.fromiter((t for c in cuts for t in c), dtype=np.int64, count=int(sizes.sum()))
        owner = np.repeat(np.arange(len(cuts)), sizes)
        if len(flat) > 1:
            inside = owner[1:] == owner[:-1]
            a, b = flat[:-1][inside], flat[1:][inside]
            pairs, back = np.unique(a * self.n + b, return_inverse=True)
            ok = self.compatible(pairs // self.n, pairs % self.n)[back]
            for i in np.unique(owner[1:][inside][~ok]).tolist():
                cuts[i] = self.merged(fresh[i].encode("utf-8", "replace"))
        self.known.update(zip(fresh, cuts, strict=True))

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        import regex

        if len(self.known) > REMEMBERED:
            self.known.clear()
        cut = regex.compile(WORDS).findall
        words = [cut(t) if t else [] for t in texts]
        self.learn({w for ws in words for w in ws})
        known = self.known
        return [[t for w in ws for t in known[w]] for ws in words]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = BYTE_BPE_50K, keep: tuple[str, ...] = ()) -> DataFrame:
    """``key``, the columns ``keep`` and ``ids``: the token ids of ``text``; no shuffle."""
    source = spread(df.select(*(F.col(c) for c in (key, *keep)), F.col(text).cast("string").alias("__text")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]) + ", ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in batches:
            ids = v.encode_batch(b.column(b.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(ids, type=pa.list_(pa.int32()))], names=[*b.schema.names[:-1], "ids"])

    return source.mapInArrow(run, schema)
