"""Sound vectors: words placed so that inner products come near their order-keeping alignment.

The encoder is trained on the alignment score itself (a Nyström embedding): LANDMARKS
words are drawn, a word is described by its alignment with each of them, and the
eigenvectors of the landmarks' own scores turn this description into at most ``dims``
numbers. Training needs the landmarks only; embedding is one pass without a shuffle.

Defined cases: case is levelled; letters without features count as silent; a null word
has no vector; an empty word is its two boundary marks; a vocabulary with fewer words
than LANDMARKS uses all of them, an empty one cannot be fitted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calembour.operators.layout import spread

#: Words drawn for training, by the least hash: the bound of the sample.
LANDMARKS = 256


class SoundModel:
    """``features``: letter -> one mark a feature, ``+`` if it has it; at most 14 features. ``turn``: what training gave, if it is over."""

    def __init__(self, features: dict[str, str], landmarks: list[str], dims: int = 50, turn: np.ndarray | None = None):
        n = max(map(len, features.values()), default=0)
        self.masks = {c: sum(1 << i for i, m in enumerate(marks) if m == "+") for c, marks in features.items()}
        self.begin, self.end = 1 << n, 2 << n
        self.ones = np.array([x.bit_count() for x in range(4 << n)], dtype=np.int64)
        grams = [self.grams(w) for w in landmarks]
        self.lengths = np.array([len(g) for g in grams])
        self.known = np.zeros((len(grams), self.lengths.max(initial=1)), dtype=np.int64)
        for row, g in zip(self.known, grams, strict=True):
            row[: len(g)] = g
        self.turn = self.trained(grams, dims) if turn is None else turn
        # tasks must not train again: eigenvectors may differ from machine to machine
        self.args = (features, landmarks, dims, self.turn)

    def trained(self, grams: list[np.ndarray], dims: int) -> np.ndarray:
        scores = np.array([self.alignment(g) for g in grams]).reshape(len(grams), len(grams))
        values, vectors = np.linalg.eigh((scores + scores.T) / 2)
        kept = [i for i in np.argsort(values)[::-1][:dims] if values[i] > 1e-6 * values.max()]
        return vectors[:, kept] / np.sqrt(values[kept])

    def grams(self, word: str) -> np.ndarray:
        """The united features of each two neighbours of a word between its boundary marks."""
        marks = np.array([self.begin, *(self.masks.get(c, 0) for c in word.lower()), self.end], dtype=np.int64)
        return marks[:-1] | marks[1:]

    def alignment(self, grams: np.ndarray) -> np.ndarray:
        """Best total similarity of an order-keeping alignment with each landmark, over the longer length."""
        total = np.zeros((len(self.known), self.known.shape[1] + 1))
        for g in grams:
            union = self.ones[self.known | g]
            same = np.where(union > 0, self.ones[self.known & g] / np.maximum(union, 1), 0.0)
            total[:, 1:] = np.maximum.accumulate(np.maximum(total[:, 1:], total[:, :-1] + same), axis=1)
        return total[np.arange(len(self.known)), self.lengths] / np.maximum(len(grams), self.lengths)

    def embed(self, word: str) -> np.ndarray:
        return self.alignment(self.grams(word)) @ self.turn


def fit(words: DataFrame, features: dict[str, str], word: str = "word", landmarks: int = LANDMARKS, dims: int = 50) -> SoundModel:
    """Train on ``landmarks`` of the distinct words."""
    drawn = words.select(F.col(word).alias("w")).where("w IS NOT NULL").distinct().orderBy(F.xxhash64("w"), "w").limit(landmarks)
    rows = [r["w"] for r in drawn.collect()]
    if not rows:
        raise ValueError("no words to fit a sound model on")
    return SoundModel(features, rows, dims)


def embedded(df: DataFrame, model: SoundModel, word: str = "word", to: str = "embedding") -> DataFrame:
    """``df`` with the sound vector of ``word``; the model sent along has the size of its landmarks."""
    args = model.args

    @F.pandas_udf("array<double>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = SoundModel(*args)
        for b in batches:
            yield b.map(lambda w: own.embed(w).tolist(), na_action="ignore")

    return spread(df).withColumn(to, vectors(F.col(word).cast("string")))
