"""Packing of token examples into sequences under three limits at once.

An example is a run of ids; its demand is a vector: tokens, one segment, and the tokens
that bear loss. A sequence has a capacity in each of the three. Sequences are filled
one after the other: of the examples that fit, the one with the largest weighted dot
product of its demand and what the sequence has left goes in (a dimension that the
waiting examples ask for more weighs more). Where nothing fits any more, and cutting is
allowed, the longest waiting example is cut to fill the rest.

Every task packs the rows of its own partition, with a bounded number of examples
waiting; nothing is shuffled. What a task has left at its end, and sequences that reach
another limit before they are full, are cut at powers of two, which need no padding.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loometry.llm.arrays import LOWER, NOT_SPACE, binaries, byte_table, flat, text_slices, words
from loometry.llm.memo import WordIds

#: Bytes of text worked on at once.
SLICE = 1_500_000
#: Examples that wait in a task, and ids in an outgoing batch, about.
WAITING = 4096
OUT_IDS = 1 << 20


def encode(documents: DataFrame, tokenizer_file: str, *, key: str = "doc_id", text: str = "text", end: int = 1) -> DataFrame:
    """``key, ids``: the ids of each whole text (null: empty), then ``end``, as raw
    little-endian unsigned 32-bit numbers.

    The tokenizer drops white space and never looks beyond it (nor do its special
    tokens hold any); so the distinct words of a slice are encoded once. Neither does it
    look from a letter or digit to the stop after it, nor tell a word's first letter A-Z
    from the small one: words part there and begin small.
    """

    def run(batches):
        for keys, cells, counts in _encoded(batches, tokenizer_file, end):
            yield pa.RecordBatch.from_arrays([keys, binaries(cells, counts)], ["key", "ids"])

    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, ids binary")


def _encoded(batches, tokenizer_file: str, end: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Keys, ids end to end, and how many each row has."""
    memo = _memo(tokenizer_file)
    for batch in batches:
        for lo, hi, raw, borders in text_slices(batch.column(1), SLICE):
            raw, starts, ends = _parts(raw, borders)
            ids, counts = memo.encode(raw, borders, starts, ends)
            yield batch.column(0).slice(lo, hi - lo), np.insert(ids.astype("<u4"), np.cumsum(counts), end), counts + 1


@lru_cache(maxsize=1)
def _memo(tokenizer_file: str) -> WordIds:
    """What a worker remembers of one tokenizer, at most (``memo.REMEMBERED`` words)."""
    return WordIds(_encoder(tokenizer_file))


_STOP = ~byte_table(b".,;:!?")
_LETTER = byte_table(bytes(c for c in range(256) if not chr(c).isalnum() or c > 127))
#: Second bytes of the two-byte letters U+00C0 to U+00FF.
_LATIN = np.zeros(256, bool)
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False


def _parts(raw: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes with words begun small, and the starts and ends of their parts."""
    starts, ends, _ = words(raw, borders, NOT_SPACE)
    if not len(starts):
        return raw, starts, ends
    letter = _LETTER[raw]
    letter[1:] |= (raw[:-1] == 0xC3) & _LATIN[raw[1:]]
    stop = _STOP[raw]
    stop[1:] &= letter[:-1]
    stop[0] = False
    stop[starts] = False
    stops = np.flatnonzero(stop)
    small = raw.copy()
    small[starts] = LOWER[raw[starts]]
    return small, np.sort(np.concatenate([starts, stops])), np.sort(np.concatenate([ends, stops]))


def _encoder(tokenizer_file: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file)
    vocabulary = tokenizer.get_vocab()
    closes = np.zeros(max(vocabulary.values()) + 1, bool)
    closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def ids_of(texts: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_words(found: list[str]) -> list[list[int]]:
        """A call costs more than a word, so words of letters go together: each must then
        have just one id that closes a word. If one has more, they go one by one."""
        out: list[list[int]] = [[] for _ in found]
        single = [i for i, word in enumerate(found) if not word.isalpha()]
        joined = [i for i, word in enumerate(found) if word.isalpha()]
        for lo in range(0, len(joined), 128):
            group = joined[lo : lo + 128]
            ids = ids_of([" ".join([found[i] for i in group])])[0]
            ends = (np.flatnonzero(closes[np.array(ids, np.int64)]) + 1).tolist()
            if len(ends) != len(group) or ends[-1] != len(ids):
                single += group
                continue
            at = 0
            for i, e in zip(group, ends, strict=True):
                out[i] = ids[at:e]
                at = e
        for lo in range(0, len(single), 4096):
            group = single[lo : lo + 4096]
            for i, ids in zip(group, ids_of([found[i] for i in group]), strict=True):
                out[i] = ids
        return out

    return encode_words


class _Unit:
    """A stretch of an example, ids ``start`` onwards; the first ``prompt`` ids of the
    example bear no loss."""

    __slots__ = ("key", "start", "ids", "prompt", "total")

    def __init__(self, key, start: int, ids: np.ndarray, prompt: int, total: int):
        self.key, self.start, self.ids, self.prompt, self.total = key, start, ids, prompt, total

    def loss(self, length: int) -> int:
        return max(0, self.start + length - max(self.start, self.prompt))

    def longest(self, tokens: int, loss: int) -> int:
        """The most ids that keep within both limits."""
        return min(len(self.ids), tokens, max(0, self.prompt - self.start) + loss)

    def split(self, length: int) -> tuple[_Unit, _Unit]:
        return (
            _Unit(self.key, self.start, self.ids[:length], self.prompt, self.total),
            _Unit(self.key, self.start + length, self.ids[length:], self.prompt, self.total),
        )


class _Packer:
    def __init__(self, tokens: int, segments: int, loss: int, cut: bool):
        self.limits = (tokens, segments, loss)
        self.cut = cut
        self.units: list[_Unit] = []

    def add(self, key, ids: np.ndarray, prompt: int) -> None:
        """An example waits; one that exceeds a limit by itself is cut to the limits."""
        tokens, _, loss = self.limits
        unit = _Unit(key, 0, ids, prompt, len(ids))
        while (n := unit.longest(tokens, loss)) < len(unit.ids):
            head, unit = unit.split(n)
            self.units.append(head)
        self.units.append(unit)

    def sequences(self, keep: int) -> Iterator[list[_Unit]]:
        """Filled sequences, until ``keep`` examples or fewer wait."""
        units = self.units
        tokens, segments, loss = self.limits
        size = np.array([len(u.ids) for u in units], np.int64)
        lossy = np.array([u.loss(len(u.ids)) for u in units], np.int64)
        waiting = len(units)
        while waiting > keep:
            # Weights: the mean demand of what waits, as a share of the capacity.
            alive = size > 0
            weight_t = float(size[alive].mean()) / tokens / tokens**2
            weight_l = float(lossy[alive].mean()) / loss / loss**2
            for _ in range(64):
                if waiting <= keep:
                    break
                left_t, left_s, left_l = tokens, segments, loss
                chosen: list[_Unit] = []
                while left_t and left_s and waiting:
                    # The segment term is the same for every example.
                    score = size * (weight_t * left_t) + lossy * (weight_l * left_l)
                    score[(size > left_t) | (lossy > left_l) | (size == 0)] = -1.0
                    best = int(score.argmax())
                    if score[best] >= 0:
                        unit = units[best]
                        size[best] = lossy[best] = 0
                        waiting -= 1
                    else:
                        best = int(size.argmax())
                        n = units[best].longest(left_t, left_l)
                        if not self.cut or not n:
                            break
                        unit, rest = units[best].split(n)
                        units[best] = rest
                        size[best], lossy[best] = len(rest.ids), rest.loss(len(rest.ids))
                    chosen.append(unit)
                    left_t -= len(unit.ids)
                    left_l -= unit.loss(len(unit.ids))
                    left_s -= 1
                yield from self.whole(chosen)
        self.units = [u for u, n in zip(units, size.tolist(), strict=True) if n]

    def whole(self, chosen: list[_Unit]) -> Iterator[list[_Unit]]:
        """A sequence as it is, or cut at powers of two if it is not full."""
        total = sum(len(u.ids) for u in chosen)
        if not self.cut or total == self.limits[0] or not total & (total - 1):
            yield chosen
            return
        chosen = chosen[::-1]
        while total:
            room = 1 << (total.bit_length() - 1)
            total -= room
            part = []
            while room:
                unit = chosen.pop()
                if len(unit.ids) > room:
                    unit, rest = unit.split(room)
                    chosen.append(rest)
                part.append(unit)
                room -= len(unit.ids)
            yield part


_PIECES = "start long, length long, ids binary, n_ids long, sequence_id long, offset long"


def pack(
    examples: DataFrame, *, tokens: int = 2048, segments: int = 256, loss_tokens: int | None = None, prompt: str | None = None, cut: bool = True,
) -> DataFrame:
    """One row per piece: ``key, start, length, ids, n_ids, sequence_id, offset``.

    ``examples`` has ``key`` and ``ids`` (raw unsigned 32-bit numbers); ``prompt`` names
    a column with the number of leading ids that bear no loss (null or none: all bear
    loss). A sequence holds at most ``tokens`` ids, ``segments`` pieces and
    ``loss_tokens`` ids that bear loss (as many as ``tokens`` if not given). Every id
    lies in exactly one piece; ``start`` counts the ids of its example before it,
    ``offset`` those of its sequence, ``n_ids`` all of its example. Without ``cut``
    only examples that exceed a limit by themselves are cut.

    Null keys are kept. Repeated rows are packed each on its own. Null or empty ids give
    no piece. Other columns are ignored. An empty table gives no rows. A
    ``sequence_id`` is the partition's number times 2^36 plus a running number.
    """
    limits = _limits(tokens, segments, loss_tokens)
    rows = examples.select("key", "ids", (F.col(prompt).cast("long") if prompt else F.lit(0).cast("long")).alias("prompt"))

    def run(batches):
        def read():
            for batch in batches:
                raw, borders = flat(batch.column(1))
                ids = np.frombuffer(raw.tobytes(), "<u4")
                yield batch.column(0), ids, np.diff(borders) // 4, batch.column(2).fill_null(0).to_pylist()

        yield from _pieces(read(), _Packer(*limits, cut))

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, {_PIECES}")


def pack_texts(
    documents: DataFrame, tokenizer_file: str, *, key: str = "doc_id", text: str = "text", end: int = 1,
    tokens: int = 2048, segments: int = 256, loss_tokens: int | None = None,
) -> DataFrame:
    """``pack(encode(...))`` in one step, so that ids do not leave their task."""
    limits = _limits(tokens, segments, loss_tokens)

    def run(batches):
        read = ((keys, ids, counts, [0] * len(keys)) for keys, ids, counts in _encoded(batches, tokenizer_file, end))
        yield from _pieces(read, _Packer(*limits, True))

    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, {_PIECES}")


def _limits(tokens: int, segments: int, loss_tokens: int | None) -> tuple[int, int, int]:
    limits = (tokens, segments, tokens if loss_tokens is None else loss_tokens)
    if min(limits) < 1:
        raise ValueError("every limit must be positive")
    return limits


def _pieces(read, packer: _Packer) -> Iterator[pa.RecordBatch]:
    """Batches of pieces of the sequences that ``packer`` fills from ``read``: keys, ids
    end to end, how many each row has, and how many of those bear no loss."""
    number = TaskContext.get().partitionId() << 36
    rows: list[tuple] = []
    cells: list[np.ndarray] = []
    held = 0
    key_type = pa.int64()

    def batch_out() -> pa.RecordBatch:
        keys, starts, totals, numbers, offsets = zip(*rows, strict=True)
        sizes = np.array([len(c) for c in cells], np.int64)
        return pa.RecordBatch.from_arrays([
            pa.array(keys, key_type), pa.array(starts, pa.int64()), pa.array(sizes), binaries(np.concatenate(cells), sizes),
            pa.array(totals, pa.int64()), pa.array(numbers, pa.int64()), pa.array(offsets, pa.int64()),
        ], ["key", "start", "length", "ids", "n_ids", "sequence_id", "offset"])

    def filled():
        nonlocal key_type
        for keys, ids, counts, prompts in read:
            key_type = keys.type
            borders = np.concatenate([[0], np.cumsum(counts)]).tolist()
            for i, key in enumerate(keys.to_pylist()):
                if borders[i] == borders[i + 1]:
                    continue
                packer.add(key, ids[borders[i] : borders[i + 1]].copy(), prompts[i])
                if len(packer.units) >= WAITING:
                    yield from packer.sequences(WAITING // 2)
        yield from packer.sequences(0)

    for sequence in filled():
        at = 0
        for unit in sequence:
            rows.append((unit.key, unit.start, unit.total, number, at))
            cells.append(unit.ids)
            at += len(unit.ids)
        number += 1
        held += at
        if held >= OUT_IDS:
            yield batch_out()
            rows, cells, held = [], [], 0
    if rows:
        yield batch_out()
