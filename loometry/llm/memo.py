"""Ids of texts by way of their distinct words.

A slice of texts is cut into words that a tokenizer never looks beyond; each
distinct word is encoded once and remembered by its worker.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np

from loometry.llm.arrays import ranges, span_hashes

#: Distinct words a worker remembers; beyond it starts anew.
REMEMBERED = 1_000_000


class WordIds:
    """``encode_words`` gives the ids of each of a list of distinct words."""

    def __init__(self, encode_words: Callable[[list[str]], list[list[int]]]):
        self.encode_words = encode_words
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.slot = np.zeros(0, np.int64)
        self.cells = np.zeros(0, np.int32)
        self.start = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)

    def encode(
        self, raw: np.ndarray, borders: np.ndarray, starts: np.ndarray, ends: np.ndarray | None = None
    ) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows end to end and how many each row has. Words begin at
        ``starts`` and end at ``ends``, or where the next begins; every non-empty row
        then begins one."""
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(borders) - 1, np.int64)
        if ends is None:
            ends = np.append(starts[1:], len(raw))
        unique, place, inverse = np.unique(span_hashes(raw, starts, ends), return_index=True, return_inverse=True)
        self._learn(raw, starts[place], ends[place], unique)
        slot = self.slot[np.searchsorted(self.known, unique)][inverse]
        counts = self.count[slot]
        ids = self.cells[ranges(self.start[slot], counts)]
        total = np.concatenate([[0], np.cumsum(counts)])
        return ids, np.diff(total[np.searchsorted(starts, borders)])

    def _learn(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> None:
        if len(self.known) > REMEMBERED:
            self.forget()
        at = np.searchsorted(self.known, hashes)
        new = np.ones(len(hashes), bool)
        if len(self.known):
            new = self.known[np.minimum(at, len(self.known) - 1)] != hashes
        fresh = np.flatnonzero(new)
        if not len(fresh):
            return
        data = raw.tobytes()
        cells = self.encode_words([data[a:b].decode() for a, b in zip(starts[fresh].tolist(), ends[fresh].tolist(), strict=True)])
        counts = np.array([len(c) for c in cells], np.int64)
        base = len(self.cells)
        self.cells = np.concatenate([self.cells, np.fromiter(chain.from_iterable(cells), np.int32, int(counts.sum()))])
        self.slot = np.insert(self.slot, at[fresh], len(self.count) + np.arange(len(cells)))
        self.known = np.insert(self.known, at[fresh], hashes[fresh])
        self.start = np.concatenate([self.start, base + np.cumsum(counts) - counts])
        self.count = np.concatenate([self.count, counts])
