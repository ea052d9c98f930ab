"""Benchmark decontamination by suffix arrays over the training texts.

Every slice of the documents is a shard with a suffix array over its words:
places sorted by the words that follow. Each suffix of each benchmark item is
looked up in it by binary search, which gives its verbatim matches and where
they lie. Suffixes that share no word run of a window's length with the
benchmark can not match and stay out of the array.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loometry.llm.arrays import ALNUM, LOWER, covered, ranges, slices, span_hashes, text_slices, tidy, words
from loometry.session import cut_lineage

#: Text of the benchmark in one block, and in the blocks that a task holds at once.
#: A larger benchmark takes more passes, each written to the shared folder.
BLOCK_BYTES = 4 << 20
PASS_BYTES = 16 << 20
#: Pairs (place in the benchmark, place in a slice) looked at together.
_PAIRS = 1 << 20
#: Words are written as three digits of base 255, none of them zero.
_WIDTH = 3


def _codes(ranks: np.ndarray) -> np.ndarray:
    """Order-preserving bytes of word ranks; rank -1, an unknown word, is zero bytes."""
    out = np.empty((len(ranks), _WIDTH), np.uint8)
    rest = np.maximum(ranks, 0)
    for i in range(_WIDTH - 1, -1, -1):
        out[:, i] = rest % 255 + 1
        rest = rest // 255
    out[ranks < 0] = 0
    return out


@dataclass
class Items:
    """A block of benchmark items, ready for search. ``size`` is the window in words.

    Equal windows stand once; ``places[borders[i]:borders[i + 1]]`` are where window i
    begins, and windows that the same items hold share a number in ``holders``.
    """

    names: list  # per distinct set of holders: their ids as strings, nulls left out
    ids: list
    size: int
    vocabulary: np.ndarray  # sorted hashes of the words
    sequence: np.ndarray  # ranks of all words, items end to end, -1 after each
    heads: np.ndarray  # where each item begins in ``sequence``
    windows: np.ndarray  # distinct, encoded, sorted
    lengths: np.ndarray  # words in the window
    holders: np.ndarray  # index into names
    places: np.ndarray
    borders: np.ndarray

    @classmethod
    def build(cls, rows: list[tuple], size: int) -> Items:
        column = pa.array([t or "" for _, t in rows], pa.large_string())
        hashed, counts = [], []
        for _, _, raw, edges in text_slices(column):
            raw = LOWER[raw]
            starts, ends, cuts = words(raw, edges, ALNUM)
            hashed.append(span_hashes(raw, starts, ends))
            counts.append(np.diff(cuts))
        values = np.concatenate(hashed) if hashed else np.zeros(0, np.uint64)
        counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        vocabulary, ranks = np.unique(values, return_inverse=True)
        heads = np.cumsum(counts) - counts
        sequence = np.full(len(values) + len(counts) + size, -1, np.int64)
        sequence[np.arange(len(values)) + np.repeat(np.arange(len(counts)), counts)] = ranks
        heads = heads + np.arange(len(counts))
        n_windows = np.where(counts == 0, 0, np.maximum(counts - size + 1, 1))
        owners = np.repeat(np.arange(len(counts)), n_windows)
        places = ranges(heads, n_windows)
        lengths = np.minimum(counts[owners], size)
        windows, first, which = np.unique(encode(sequence, places, lengths, size), return_index=True, return_inverse=True)
        order = np.argsort(which, kind="stable")
        borders = np.searchsorted(which[order], np.arange(len(windows) + 1))
        ids = [i for i, _ in rows]
        numbers, names, holders = {}, [], np.zeros(len(windows), np.int64)
        for i in range(len(windows)):
            own = np.unique(owners[order[borders[i] : borders[i + 1]]])
            number = numbers.setdefault(own.tobytes(), len(names))
            if number == len(names):
                names.append(sorted({str(ids[o]) for o in own if ids[o] is not None}))
            holders[i] = number
        return cls(names, ids, size, vocabulary, sequence, heads, windows, lengths[first], holders, places[order], borders)

    def ranks_of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary) or not len(hashes):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1)


def encode(sequence: np.ndarray, places: np.ndarray, lengths: np.ndarray, size: int) -> np.ndarray:
    """The next ``length`` words of each place as one comparable byte string."""
    at = places[:, None] + np.arange(size)
    inside = np.arange(size) < lengths[:, None]
    ranks = np.where(inside, sequence[np.minimum(at, len(sequence) - 1)], -1)
    coded = _codes(ranks.ravel()).reshape(len(places), size * _WIDTH)
    return np.ascontiguousarray(coded).view(f"S{size * _WIDTH}").ravel()


def find(items: Items, ranks: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (distinct window of the block, place) for every occurrence of every window.

    ``ranks`` are the shard's words, ``run`` how many known words follow at each
    place within its document. A place takes part in at most one pair of each length.
    """
    nothing = np.zeros(0, np.int64)
    if not len(items.windows) or not len(ranks):
        return nothing, nothing
    full = items.lengths == items.size
    keep = run >= items.size if full.any() else np.zeros(len(ranks), bool)
    short = np.flatnonzero(~full)
    if len(short):
        # Items below a window's length: their first word must be there.
        first = np.full(len(items.vocabulary), items.size + 1)
        np.minimum.at(first, items.sequence[items.places[items.borders[short]]], items.lengths[short])
        known = ranks >= 0
        keep[known] |= run[known] >= first[ranks[known]]
    places = np.flatnonzero(keep)
    if not len(places):
        return nothing, nothing
    suffixes = encode(ranks, places, np.minimum(run[places], items.size), items.size)
    order = np.argsort(suffixes, kind="stable")
    array = suffixes[order]
    left = np.searchsorted(array, items.windows, "left")
    right = np.searchsorted(array, items.windows, "right")
    if len(short):
        # Whatever goes on after a short item counts as well.
        beyond = np.char.add(items.windows[short], b"\xff").astype(f"S{items.size * _WIDTH + 1}")
        right[short] = np.searchsorted(array.astype(f"S{items.size * _WIDTH + 1}"), beyond, "right")
    counts = np.maximum(right - left, 0)
    which = np.repeat(np.arange(len(counts)), counts)
    return which, places[order[ranges(left, counts)]]


def longest(items: Items, which: np.ndarray, places: np.ndarray, ranks: np.ndarray, cuts: np.ndarray) -> Iterator[tuple]:
    """``(place in the benchmark, place in the shard, words)`` of the longest verbatim
    matches, in bounded parts: pairs of equal windows that no equal word precedes,
    carried on word by word. ``cuts`` are the borders of the rows."""
    counts = np.diff(items.borders)[which]
    for lo, hi in slices(counts, _PAIRS):
        theirs = items.places[ranges(items.borders[which[lo:hi]], counts[lo:hi])]
        ours = np.repeat(places[lo:hi], counts[lo:hi])
        length = np.repeat(items.lengths[which[lo:hi]], counts[lo:hi])
        row = np.searchsorted(cuts, ours, "right") - 1
        before = np.where(theirs > 0, items.sequence[theirs - 1], -1)
        begins = (before < 0) | (ours == cuts[row]) | (ranks[ours - 1] != before)
        theirs, ours, length, end = theirs[begins], ours[begins], length[begins], cuts[row[begins] + 1]
        going = np.flatnonzero(length == items.size)
        while len(going):
            at = ours[going] + length[going]
            next_ours = np.where(at < end[going], ranks[np.minimum(at, len(ranks) - 1)], -2)
            going = going[(next_ours >= 0) & (items.sequence[theirs[going] + length[going]] == next_ours)]
            length[going] += 1
        yield theirs, ours, length


def shard_words(raw: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a slice's words and the borders of its rows in them."""
    raw = LOWER[raw]
    starts, ends, cuts = words(raw, borders, ALNUM)
    return span_hashes(raw, starts, ends), cuts


def known_words(hashes: np.ndarray, cuts: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of a slice's words, and how many known words follow each in its row."""
    ranks = items.ranks_of(hashes)
    stop = np.zeros(len(ranks) + 1, bool)
    stop[:-1] = ranks < 0
    stop[-1] = True
    edge = np.flatnonzero(stop)
    run = edge[np.searchsorted(edge, np.arange(len(ranks)))] - np.arange(len(ranks))
    left = np.repeat(cuts[1:], np.diff(cuts)) - np.arange(len(ranks))
    return ranks, np.minimum(run, left)


def item_blocks(benchmark: DataFrame, size: int, block_bytes: int) -> Iterator[tuple[Items, int]]:
    """The benchmark in blocks of bounded size, with their bytes."""
    block, held = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        block.append((row[0], row[1]))
        held += len((row[1] or "").encode()) + 64
        if held >= block_bytes:
            yield Items.build(block, size), held
            block, held = [], 0
    if block:
        yield Items.build(block, size), held


def item_passes(benchmark: DataFrame, size: int, block_bytes: int, pass_bytes: int) -> Iterator[list]:
    """Broadcast blocks, as many as a task may hold at once."""
    context = benchmark.sparkSession.sparkContext
    held, amount = [], 0
    for items, n_bytes in item_blocks(benchmark, size, block_bytes):
        held.append(context.broadcast(items))
        amount += n_bytes
        if amount >= pass_bytes:
            yield held
            held, amount = [], 0
    if held:
        yield held


def matches(
    documents: DataFrame, benchmark: DataFrame, size: int = 13, block_bytes: int = BLOCK_BYTES, pass_bytes: int = PASS_BYTES
) -> DataFrame:
    """Longest verbatim matches: ``doc_id, item_id, doc_word, item_word, n_words``,
    one row per place where a match begins (one that another match of the same
    item contains, starting a word later, is left out)."""
    schema = f"doc_id {dict(documents.dtypes)['doc_id']}, item_id {dict(benchmark.dtypes)['item_id']}, doc_word long, item_word long, n_words long"
    id_type = _arrow_type(benchmark, "item_id")
    found = documents.sparkSession.createDataFrame([], schema)
    for shared in item_passes(benchmark, size, block_bytes, pass_bytes):

        def search(batches, shared=shared):
            for batch in batches:
                for lo, _, raw, borders in text_slices(batch.column(1)):
                    hashes, cuts = shard_words(raw, borders)
                    for items in (b.value for b in shared):
                        ranks, run = known_words(hashes, cuts, items)
                        for theirs, ours, length in longest(items, *find(items, ranks, run), ranks, cuts):
                            row = np.searchsorted(cuts, ours, "right") - 1
                            item = np.searchsorted(items.heads, theirs, "right") - 1
                            yield pa.RecordBatch.from_arrays([
                                batch.column(0).take(pa.array(lo + row)), pa.array([items.ids[i] for i in item], id_type),
                                pa.array(ours - cuts[row]), pa.array(theirs - items.heads[item]), pa.array(length),
                            ], ["doc_id", "item_id", "doc_word", "item_word", "n_words"])

        found = found.unionAll(documents.select("doc_id", "text").mapInArrow(tidy(search), schema))
    return found


def _arrow_type(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)


def _digest(names: set) -> tuple[int, str]:
    return len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


def contamination(
    documents: DataFrame, benchmark: DataFrame, *, size: int = 13, share: int = 20,
    block_bytes: int = BLOCK_BYTES, pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """All columns of ``documents`` plus ``n_words, n_hit, n_items, items_sha256,
    contaminated, n_longest`` under the name ``_found`` (a struct, so that no name
    clashes; a column ``_found`` of the input is replaced).

    A window is ``size`` consecutive words of an item, or a shorter item whole. A
    document word inside an occurrence of any window is hit. A document is
    contaminated if any word is hit and ``share * n_hit >= n_words``; ``n_longest``
    counts the words of its longest verbatim match with one item. Words are
    those of the lower-cased text; null and empty texts have none. Repeated rows
    are judged each on its own. Items with a null id hit words, but are not
    listed. No benchmark: nothing is hit. Windows that many items share are looked
    up once, whatever their number.

    A task runs one Python worker, which goes over the blocks of a pass one after the
    other. Between passes the texts and what was hit are written to the shared folder.
    """
    columns = [c for c in documents.columns if c != "_found"]
    row = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")
    state = "hit binary, items array<string>, n_longest long"
    rows = documents.select(row, "text", *[F.lit(None).cast(t).alias(n) for n, t in (x.split() for x in state.split(", "))])
    row_type = rows.schema["row"].dataType.simpleString()
    verdict = "n_words:long,n_hit:long,n_items:long,items_sha256:string,contaminated:boolean,n_longest:long"

    def look_up(batches, shared, last):
        for batch in batches:
            hits, names, longest_of, totals, digests = [], [], [], [], []
            earlier = [batch.column(i) for i in (2, 3, 4)]
            for lo, hi, raw, borders in text_slices(batch.column(1)):
                hashes, cuts = shard_words(raw, borders)
                hit = np.zeros(len(hashes), bool)
                most = earlier[2][lo:hi].fill_null(0).to_numpy(zero_copy_only=False).copy()
                sets: list[set] = [set() for _ in range(hi - lo)]
                for n, items in enumerate(b.value for b in shared):
                    ranks, run = known_words(hashes, cuts, items)
                    which, places = find(items, ranks, run)
                    if not len(which):
                        continue
                    hit |= covered(len(ranks), places, places + items.lengths[which])
                    of = np.searchsorted(cuts, places, "right") - 1
                    for i, holder in np.unique(np.stack([of, items.holders[which]], 1), axis=0).tolist():
                        sets[i].add((n, holder))
                    for _, ours, length in longest(items, which, places, ranks, cuts):
                        np.maximum.at(most, np.searchsorted(cuts, ours, "right") - 1, length)
                known: dict = {}
                for i in range(hi - lo):
                    mine = hit[cuts[i] : cuts[i + 1]]
                    if earlier[0][lo + i].is_valid:
                        mine = mine | np.unpackbits(np.frombuffer(earlier[0][lo + i].as_py(), np.uint8), count=len(mine)).astype(bool)
                    before = earlier[1][lo + i].as_py() or []
                    key = (frozenset(sets[i]), tuple(before))
                    if key not in known:
                        own = set(before).union(*(shared[n].value.names[h] for n, h in sets[i]))
                        known[key] = _digest(own) if last else sorted(own)
                    if last:
                        totals.append((len(mine), int(mine.sum())))
                        digests.append(known[key])
                    else:
                        hits.append(np.packbits(mine).tobytes())
                        names.append(known[key])
                longest_of.append(most)
            most = pa.array(np.concatenate(longest_of) if longest_of else np.zeros(0, np.int64), pa.int64())
            if not last:
                cells = [batch.column(0), batch.column(1), pa.array(hits, pa.binary()), pa.array(names, pa.list_(pa.string())), most]
                yield pa.RecordBatch.from_arrays(cells, ["row", "text", "hit", "items", "n_longest"])
                continue
            a, b = np.array(totals, np.int64).reshape(-1, 2).T
            found = pa.StructArray.from_arrays(
                [pa.array(a), pa.array(b), pa.array([n for n, _ in digests], pa.int64()), pa.array([d for _, d in digests], pa.string()), pa.array((b > 0) & (share * b >= a)), most],
                [x.split(":")[0] for x in verdict.split(",")],
            )
            yield pa.RecordBatch.from_arrays([batch.column(0), found], ["row", "found"])

    passes = item_passes(benchmark, size, block_bytes, pass_bytes)
    now = next(passes, [])
    for following in passes:
        step = partial(look_up, shared=now, last=False)
        rows = cut_lineage(rows.mapInArrow(tidy(step), f"row {row_type}, text string, {state}"), "hits")
        now = following
    judged = rows.mapInArrow(tidy(partial(look_up, shared=now, last=True)), f"row {row_type}, found struct<{verdict}>")
    return judged.select(*[F.col("row")[c].alias(c) for c in columns], F.col("found").alias("_found"))


def remove_contaminated(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with their columns."""
    return contamination(documents, benchmark, **options).filter("NOT _found.contaminated").select(*[F.col(f"`{c}`") for c in documents.columns])
