"""NumPy helpers for work inside Arrow tasks: texts as flat byte arrays, words,
rolling hashes and sliding minima. All of it works on slices of bounded size."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; the powers of a slice then fit 2^19. One longer
#: document forms a slice of its own.
SLICE_BYTES = 500_000

_MULT = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
U64 = np.uint64


def byte_table(separators: bytes) -> np.ndarray:
    """Whether each byte value belongs to a word."""
    table = np.ones(256, bool)
    table[np.frombuffer(separators, np.uint8)] = False
    return table


#: Words are runs of anything but white space.
NOT_SPACE = byte_table(b" \t\n\v\f\r")
#: Words are runs of digits, letters a-z and non-ASCII characters, after lower-casing.
ALNUM = byte_table(bytes(c for c in range(128) if not (48 <= c <= 57 or 97 <= c <= 122)))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def slices(lengths: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each."""
    ends = np.cumsum(lengths)
    lo = 0
    while lo < len(lengths):
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield lo, hi
        lo = hi


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its row borders (nulls: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    borders = np.frombuffer(offsets, kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[borders[0] : borders[-1]], borders - borders[0]


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(lo, hi, bytes, borders)`` for row ranges of bounded size."""
    raw, borders = flat(column)
    for lo, hi in slices(np.diff(borders), limit):
        yield lo, hi, raw[borders[lo] : borders[hi]], borders[lo : hi + 1] - borders[lo]


def words(raw: np.ndarray, borders: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the border of each row in the words."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(borders), np.int64)
    inside = table[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = borders[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, borders)


#: Powers kept for the next call, at most so many of each base and of its inverse.
_KEPT_POWERS = 1 << 21
_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(size: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    base = _MULT[which]
    out = []
    for step in (base, pow(base, -1, 1 << 64)):
        power = np.full(size, step, U64)
        power[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(power, out=power)
        out.append(power)
    return tuple(out)


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of the base and of its inverse. A longer table serves for
    shorter ones; those for a very long text are made anew."""
    size = 1 << max(16, int(n).bit_length())
    if size > _KEPT_POWERS:
        return _powers(size, which)
    if which not in _TABLES or len(_TABLES[which][0]) < size:
        _TABLES[which] = _powers(size, which)
    return _TABLES[which]


def free() -> None:
    """Give what a task has used back to the system: workers are used again, and what
    they keep adds up."""
    _TABLES.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(step: Callable) -> Callable:
    """``step`` for ``mapInArrow``, freeing its memory at the end of the task."""

    def run(batches):
        try:
            yield from step(batches)
        finally:
            free()

    return run


#: Bytes of a group from which on its memory is given back.
_LARGE_GROUP = 32 << 20


def tidy_group(step: Callable) -> Callable:
    """``step`` for ``applyInArrow``, freeing its memory after a large group."""

    def run(group: pa.Table) -> pa.Table:
        try:
            return step(group)
        finally:
            if group.nbytes >= _LARGE_GROUP:
                free()

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a hash so that all of its bits depend on all of the input's."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _prefix_sums(symbols: np.ndarray, which: int) -> np.ndarray:
    up, _ = powers(len(symbols) + 1, which)
    terms = symbols.astype(U64)
    terms += U64(1)
    terms *= up[: len(symbols)]
    total = np.zeros(len(symbols) + 1, U64)
    np.cumsum(terms, out=total[1:])
    return total


def span_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of ``symbols[start:end]`` for many spans at once (polynomial prefix sums)."""
    _, down = powers(len(symbols) + 1, which)
    total = _prefix_sums(symbols, which)
    value = total[ends] - total[starts]
    value *= down[starts]
    value ^= (ends - starts).astype(U64) * U64(_MULT[1 - which])
    return mix(value)


def window_hashes(symbols: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """Hash of every run of ``size`` symbols."""
    n = len(symbols) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    _, down = powers(len(symbols) + 1, which)
    total = _prefix_sums(symbols, which)
    value = total[size:] - total[:-size]
    del total
    value *= down[:n]
    value ^= U64(size * _MULT[1 - which] % (1 << 64))
    return mix(value)


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every run of ``size`` values."""
    width, out = 1, values
    while width * 2 <= size:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    if width < size:
        rest = size - width
        out = np.minimum(out[:-rest], out[rest:])
    return out


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``start, start+1, ...`` of each range, end to end."""
    counts = np.asarray(counts, np.int64)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.asarray(starts, np.int64) - (np.cumsum(counts) - counts)
    return np.arange(total) + np.repeat(shift, counts)


def covered(size: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of ``size`` places lie inside any of the spans."""
    steps = np.bincount(starts, minlength=size + 1)[: size + 1] - np.bincount(ends, minlength=size + 1)[: size + 1]
    return np.cumsum(steps)[:size] > 0


def binaries(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Cut ``values`` into binary cells of ``counts`` items each."""
    item = values.dtype.itemsize
    offsets = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(np.asarray(counts, np.int64) * item, out=offsets[1:])
    data = pa.py_buffer(np.ascontiguousarray(values).tobytes())
    if offsets[-1] >= 1 << 31:
        raise ValueError("a batch of cells exceeds 2 GB")
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), data])
