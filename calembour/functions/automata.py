"""Finite automata over whole batches of strings.

All strings of a batch are laid end to end, each closed by an end mark that leads
back to the start state, and cut into chunks of equal length. Each chunk's effect is
a function from entry state to exit state; the functions of all chunks are composed
by prefix doubling, which gives every chunk its entry state without walking the text
in order. A second pass then yields the state before every character.
"""

from __future__ import annotations

import numpy as np

CHUNK = 128


class Automaton:
    """``classes``: character -> class number; ``table[class][state]`` -> next state.

    Class 0 is any other character, class 1 the end mark of a string.
    """

    def __init__(self, classes: dict[str, int], table: list[list[int]], start: int = 0):
        self.table = np.asarray(table, dtype=np.int8)
        self.start = start
        self.lookup = np.zeros(256, dtype=np.int8)
        self.wide = {}
        for ch, c in classes.items():
            if ord(ch) < 256:
                self.lookup[ord(ch)] = c
            else:
                self.wide[ord(ch)] = c

    def classify(self, codes: np.ndarray) -> np.ndarray:
        out = self.lookup[np.minimum(codes, 255)]
        out[codes > 255] = 0
        if self.wide:
            for code, c in self.wide.items():
                out[codes == code] = c
        return out

    def chunk_functions(self, cls: np.ndarray) -> np.ndarray:
        """[chunk, entry state] -> exit state of each row of ``cls`` ([chunk, position])."""
        states = np.broadcast_to(np.arange(self.table.shape[1], dtype=np.int8), (cls.shape[0], self.table.shape[1])).copy()
        for j in range(cls.shape[1]):
            states = self.table[cls[:, j, None], states]
        return states

    @staticmethod
    def compose_prefixes(functions: np.ndarray) -> np.ndarray:
        """Row i becomes the composition of rows 0..i, in log2(rows) rounds."""
        done, step = functions.copy(), 1
        while step < len(done):
            joined = np.take_along_axis(done[step:], done[:-step].astype(np.int64), axis=1)
            done[step:] = joined
            step *= 2
        return done

    def run(self, cls: np.ndarray) -> np.ndarray:
        """The state before each position of ``cls``."""
        n = len(cls)
        if n == 0:
            return np.zeros(0, dtype=np.int8)
        width = min(CHUNK, n)
        # the padding is end marks: they lead back to the start and are cut off
        padded = np.ones(-(-n // width) * width, dtype=np.int8)
        padded[:n] = cls
        blocks = padded.reshape(-1, width)
        entry = np.full(len(blocks), self.start, dtype=np.int8)
        if len(blocks) > 1:
            entry[1:] = self.compose_prefixes(self.chunk_functions(blocks))[:-1, self.start]
        states, now = np.empty_like(blocks), entry
        for j in range(width):
            states[:, j] = now
            now = self.table[blocks[:, j], now]
        return states.reshape(-1)[:n]


def lay_out(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, each followed by one slot for its end mark; starts and ends (of the slot)."""
    lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    codes = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return codes, starts, ends
