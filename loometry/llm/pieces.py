"""SentencePiece encoding and decoding by a forward pass over a trie of words.

A text is cut into marked words: a word and the spaces before it. The distinct
words of a slice are sorted, which is the order of a depth-first walk through
their trie, and each word takes over the forward states of the prefix it shares
with the word before. The vocabulary is of the merging kind, so the best path to
a place is not the one with the largest sum of scores but the one whose
neighbouring pieces the merges would leave apart; there is exactly one.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loometry.llm.arrays import ranges, slices, text_slices, tidy
from loometry.llm.memo import WordIds

MARK = "▁"
_SPACE = 32
#: Pairs of pieces whose merging a worker remembers (some 120 bytes each).
REMEMBERED_PAIRS = 400_000
#: Ids decoded at once, about.
SLICE_IDS = 1 << 19


class Pieces:
    """A vocabulary, its merge rule on pairs, and the pieces of the words met so far."""

    def __init__(self, model_file: str):
        self.processor = sentencepiece.SentencePieceProcessor(model_file=model_file)
        p = self.processor
        self.size = p.vocab_size()
        self.unknown = p.unk_id()
        self.byte_ids = {}
        self.ids: dict[str, int] = {}
        shown: list[bytes] = []
        for i in range(self.size):
            piece = p.id_to_piece(i)
            if p.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                shown.append(bytes([int(piece[3:5], 16)]))
            elif p.is_control(i) or p.is_unknown(i):
                shown.append(b"" if p.is_control(i) else " ⁇ ".encode())
            else:
                self.ids[piece] = i
                shown.append(piece.replace(MARK, " ").encode())
        if any(MARK in piece.lstrip(MARK) for piece in self.ids):
            raise ValueError("pieces that go over a word's border are not supported")
        self.score = {piece: p.get_score(i) for piece, i in self.ids.items()}
        self.piece = {i: piece for piece, i in self.ids.items()}
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.shown_length = np.array([len(x) for x in shown], np.int64)
        self.shown_start = np.cumsum(self.shown_length) - self.shown_length
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        self.apart: dict[int, bool] = {}
        self.memo = WordIds(self.encode_words)

    def merges(self, text: str) -> list[str]:
        """Merge the pair of highest score, the leftmost of equals, until none is left."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether the merges of the two pieces' joint text give back the two."""
        key = left * self.size + right
        found = self.apart.get(key)
        if found is None:
            a, b = self.piece[left], self.piece[right]
            found = self.apart[key] = self.merges(a + b) == [a, b]
        return found

    def alone(self, piece: int) -> bool:
        key = -1 - piece
        found = self.apart.get(key)
        if found is None:
            found = self.apart[key] = self.merges(self.piece[piece]) == [self.piece[piece]]
        return found

    def walk(self, words: list[str]) -> Iterator[list[int]]:
        """Pieces of each of the sorted words.

        ``last[i]`` is the final piece of the first i characters (-1: a character
        outside the vocabulary) and ``back[i]`` where it begins. A place depends on
        its prefix only, so states stay valid for the next word as far as both agree.
        """
        last, back = [0], [0]
        before = ""
        apart, alone, matches = self.stay_apart, self.alone, self.automaton.iter
        seen = self.apart
        size = self.size
        for word in words:
            shared = len(os.path.commonprefix((before, word)))
            before = word
            n = len(word)
            del last[shared + 1 :], back[shared + 1 :]
            last += [-1] * (n - shared)
            back += range(shared, n)
            done = shared
            for end, (length, piece) in matches(word):
                end += 1
                if end <= done:
                    continue
                start = end - length
                left = last[start]
                if start and left >= 0:
                    ok = seen.get(left * size + piece)
                    if ok is None:
                        ok = apart(left, piece)
                else:
                    ok = alone(piece)
                if ok:
                    last[end], back[end] = piece, start
                    done = end
            out, at = [], n
            while at:
                piece = last[at]
                if piece >= 0:
                    out.append(piece)
                elif self.byte_ids:
                    out += [self.byte_ids[b] for b in reversed(word[at - 1].encode())]
                else:
                    out.append(self.unknown)
                at = back[at]
            out.reverse()
            yield out

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Pieces of distinct words, whose spaces stand for marks, in the order given."""
        if len(self.apart) > REMEMBERED_PAIRS:
            self.apart.clear()
        marked_words = [w.replace(" ", MARK) for w in words]
        order = sorted(range(len(words)), key=marked_words.__getitem__)
        out: list[list[int]] = [[]] * len(words)
        for i, cell in zip(order, self.walk([marked_words[i] for i in order]), strict=True):
            out[i] = cell
        return out

    def encode(self, raw: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows end to end, and how many each row has. ``raw`` holds a
        space for every mark, the leading one included."""
        space = raw == _SPACE
        first = space.copy()
        first[1:] &= ~space[:-1]
        first[borders[:-1][borders[:-1] < len(raw)]] = True
        return self.memo.encode(raw, borders, np.flatnonzero(first))

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all rows end to end and their lengths, without the leading mark."""
        lengths = self.shown_length[ids]
        raw = self.shown[ranges(self.shown_start[ids], lengths)]
        total = np.concatenate([[0], np.cumsum(lengths)])
        borders = total[np.concatenate([[0], np.cumsum(counts)])]
        size = np.diff(borders)
        lead = np.zeros(len(size), bool)
        some = size > 0
        lead[some] = raw[borders[:-1][some]] == _SPACE
        keep = np.ones(len(raw), bool)
        keep[borders[:-1][lead]] = False
        return raw[keep], size - lead


_LOADED: dict[str, Pieces] = {}


def loaded(model_file: str) -> Pieces:
    """The vocabulary, once per worker process."""
    if model_file not in _LOADED:
        _LOADED[model_file] = Pieces(model_file)
    return _LOADED[model_file]


def marked(raw: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Put a space before every row that is not empty; a literal mark becomes a space."""
    mark = np.frombuffer(MARK.encode(), np.uint8)
    at = np.flatnonzero((raw[:-2] == mark[0]) & (raw[1:-1] == mark[1]) & (raw[2:] == mark[2])) if len(raw) > 2 else np.zeros(0, int)
    if len(at):
        raw = raw.copy()
        raw[at] = _SPACE
        drop = np.concatenate([at + 1, at + 2])
        keep = np.ones(len(raw), bool)
        keep[drop] = False
        borders = borders - np.searchsorted(np.sort(drop), borders)
        raw = raw[keep]
    some = np.diff(borders) > 0
    out = np.insert(raw, borders[:-1][some], _SPACE)
    return out, borders + np.concatenate([[0], np.cumsum(some)])


def encode(documents: DataFrame, model_file: str, *, text: str = "text") -> DataFrame:
    """All columns plus ``_ids`` (array of int): what the SentencePiece library gives
    for the whole text, without begin and end ids; and ``_same``, whether the ids decode
    to the text again (they do unless it holds the mark itself). Null and empty texts
    have no ids. The file lies on every machine. Rows stand on their own; nothing is
    shuffled."""
    columns = documents.columns
    packed = documents.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"))
    place = columns.index(text)

    def run(batches):
        pieces = loaded(model_file)
        # The words of one task: workers are used again for other things.
        pieces.memo.forget()
        for batch in batches:
            for lo, hi, raw, borders in text_slices(batch.column(0).field(place)):
                ids, counts = pieces.encode(*marked(raw, borders))
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                again, sizes = pieces.decode(ids, counts)
                ends = np.cumsum(sizes)
                same = [
                    size == b - a and bool((again[end - size : end] == raw[a:b]).all())
                    for end, size, a, b in zip(ends.tolist(), sizes.tolist(), borders[:-1].tolist(), borders[1:].tolist(), strict=True)
                ]
                cell = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), cell, pa.array(same, pa.bool_())], ["row", "ids", "same"])
        pieces.memo.forget()

    out = packed.mapInArrow(tidy(run), f"row {packed.schema['row'].dataType.simpleString()}, ids array<int>, same boolean")
    return out.select(*[F.col("row")[c].alias(c) for c in columns], F.col("ids").alias("_ids"), F.col("same").alias("_same"))


def decode(rows: DataFrame, model_file: str, *, ids: str = "_ids") -> DataFrame:
    """All columns plus ``_decoded``, the text of the ids. Null ids give an empty text,
    bytes that are no UTF-8 the replacement character."""
    columns = rows.columns
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.coalesce(F.col(f"`{ids}`"), F.array().cast("array<int>")).alias("ids"))

    def run(batches):
        pieces = loaded(model_file)
        for batch in batches:
            cell = batch.column(1)
            borders = cell.offsets.to_numpy()
            for lo, hi in slices(np.diff(borders), SLICE_IDS):
                ids = cell.values[borders[lo] : borders[hi]].to_numpy(zero_copy_only=False)
                raw, sizes = pieces.decode(ids, np.diff(borders[lo : hi + 1]))
                data, at, texts = raw.tobytes(), 0, []
                for size in sizes.tolist():
                    texts.append(data[at : at + size].decode("utf-8", "replace"))
                    at += size
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(texts, pa.string())], ["row", "text"])

    out = packed.mapInArrow(tidy(run), f"row {packed.schema['row'].dataType.simpleString()}, text string")
    return out.select(*[F.col("row")[c].alias(c) for c in columns], F.col("text").alias("_decoded"))
