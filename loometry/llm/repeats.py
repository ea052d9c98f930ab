"""Finding repeated windows of symbols (bytes or words) across documents.

1. Every window is told by its minimiser, the least-hashed run of ``k`` symbols in
   it; consecutive windows that share one form a super-k-mer. A window can only
   repeat if its minimiser does, so minimisers are counted first, as hashes packed
   by bucket.
2. Super-k-mers of repeated minimisers travel as one string to the minimiser's
   bucket, where a ``Judge`` finds the repeated windows exactly, a few minimisers at
   a time. Those of a minimiser with very many documents travel one window per
   string, dealt by the window, so that no bucket holds a whole family.
3. The windows found return to their documents.

Copies of a text are folded into one document first. Packed cells hold what a
slice of documents has for one bucket; equal strings of a slice travel once.
"""

from __future__ import annotations

import gc
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loometry.llm.arrays import U64, flat, ranges, sliding_min, span_hashes, text_slices, tidy, tidy_group, window_hashes
from loometry.session import cut_lineage

#: Entries of one minimiser beyond which its windows are dealt one by one.
MANY = 4096
#: Bytes of distinct text for each bucket, about; never fewer buckets than shuffle partitions.
BUCKET_BYTES = 32 << 20
#: Bytes of text worked on at once: its powers (``arrays``) fit 2^19.
SLICE_BYTES = 450_000
#: Entries of minimisers, and bytes of strings, that are sorted at once; a bucket may hold more.
DECIDE_ENTRIES, JUDGE_BYTES = 1 << 18, 1 << 18
NO_ID = (1 << 63) - 1
_FOUND = np.dtype([("first", "<u4"), ("mask", "<u8")])
#: Minimiser hashes travel as six bytes; that more of them agree by chance only lets
#: a few more windows through to the exact step.
_MASK = U64((1 << 48) - 1)
#: How flagged windows travel: as a string or one by one.
STRING, SINGLE = 0, 1


@dataclass(frozen=True)
class Scheme:
    """``symbols(bytes, borders)`` gives the symbols, the row borders in them and the
    byte spans of each; ``judge`` finds the repeated windows of a bucket."""

    window: int
    k: int  # of the minimisers: long enough to be rare
    within: bool  # whether repeats inside one document count
    symbols: Callable
    judge: Callable


def minimisers(symbols: np.ndarray, cuts: np.ndarray, size: int, k: int):
    """Of each window within a row: row, place, place of its minimiser and its hash."""
    n = len(symbols)
    none = np.zeros(0, np.int64)
    if n < size:
        return none, none, none, np.zeros(0, U64)
    hashes = window_hashes(symbols, k)
    least = hashes & U64(0xFFFFFFFF00000000)
    least |= np.arange(len(hashes), dtype=U64)
    least = sliding_min(least, size - k + 1)
    least &= U64(0xFFFFFFFF)
    rows = np.repeat(np.arange(len(cuts) - 1, dtype=np.int32), np.diff(cuts))
    valid = np.flatnonzero(rows[: n - size + 1] == rows[size - 1 :])
    least = least[valid].astype(np.int64)
    return rows[valid].astype(np.int64), valid, least, hashes[least] & _MASK


def runs(*marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of the runs along which no mark changes."""
    n = len(marks[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for mark in marks:
        new[1:] |= mark[1:] != mark[:-1]
    at = np.flatnonzero(new)
    return at, np.diff(np.append(at, n))


def pack6(hashes: np.ndarray) -> bytes:
    return np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack6(cell: bytes) -> np.ndarray:
    out = np.zeros((len(cell) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(cell, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _by_bucket(buckets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(buckets, kind="stable")
    values, at = np.unique(buckets[order], return_index=True)
    yield from zip(values.tolist(), np.split(order, at[1:]), strict=True)


def _portions(keys: np.ndarray, count: int) -> Iterator[np.ndarray]:
    """Places of about ``count`` portions; equal keys share one."""
    if count <= 1:
        yield np.arange(len(keys))
        return
    for _, x in _by_bucket((keys % U64(count)).astype(np.int64)):
        yield x


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A sorting order and where groups of equal keys begin in it."""
    order = np.lexsort(keys)
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    return order, np.flatnonzero(new)


def prepared(documents: DataFrame, *more: str) -> DataFrame:
    """``key`` (a null id counts as larger than all), ``tid`` (hash of the text) and ``text``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return documents.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"), F.unhex(F.substring(F.sha2(text, 256), 1, 32)).alias("tid"), text.alias("text"), *more
    )


def zipped(docs: DataFrame) -> DataFrame:
    """``docs`` with the compressed ``ztext`` in place of ``text``, to be shuffled."""
    columns = [c for c in docs.columns if c != "text"]

    def run(batches):
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for lo, hi, raw, borders in text_slices(batch.column(len(columns))):
                data = raw.tobytes()
                cells = [pack.compress(data[a:b]) for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*[c.slice(lo, hi - lo) for c in batch.columns[:-1]], pa.array(cells, pa.binary())], [*columns, "ztext"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.select(*columns).schema)
    return docs.select(*columns, "text").mapInArrow(tidy(run), f"{schema}, ztext binary")


def unzipped(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """What ``text_slices`` gives, from compressed texts."""
    unpack = zstandard.ZstdDecompressor()
    held, size, lo = [], 0, 0
    for i, cell in enumerate(column):
        held.append(unpack.decompress(cell.as_py()))
        size += len(held[-1])
        if size >= limit or i == len(column) - 1:
            borders = np.concatenate([[0], np.cumsum([len(x) for x in held])])
            yield lo, i + 1, np.frombuffer(b"".join(held), np.uint8), borders
            held, size, lo = [], 0, i + 1


def _short(tid: pa.Array) -> np.ndarray:
    """The first eight bytes of each text hash."""
    raw, _ = flat(tid)
    return np.ascontiguousarray(raw.reshape(-1, 16)[:, :8]).view("<i8").ravel()


def flagged_minimisers(docs: DataFrame, scheme: Scheme, buckets: int) -> DataFrame:
    """``text, hashes, modes``: for each text the minimisers that occur again, packed,
    and how their windows travel; a text has one row."""
    kinds = "bucket long, hashes binary, multi binary, texts binary, counts binary"
    names = [x.split()[0] for x in kinds.split(", ")]

    def emit(batches):
        for batch in batches:
            short = _short(batch.column(0))
            for lo, hi, raw, borders in text_slices(batch.column(1), SLICE_BYTES):
                symbols, cuts, _, _ = scheme.symbols(raw, borders)
                own, _, least, hashes = minimisers(symbols, cuts, scheme.window, scheme.k)
                if not len(own):
                    continue
                at, _ = runs(own, least)
                text, value = short[lo:hi][own[at]], hashes[at]
                order, heads = _groups(value, text)  # by text
                members = np.diff(np.append(heads, len(order)))
                value, text, several = value[order[heads]], text[order[heads]], members > 1
                # Known to repeat inside the slice already.
                order, heads = _groups(value)
                members = np.diff(np.append(heads, len(order)))
                inside = np.logical_or.reduceat(several[order], heads) if scheme.within else np.zeros(len(heads), bool)
                multi = np.empty(len(order), bool)
                multi[order] = np.repeat((members > 1) | inside, members)
                for bucket, x in _by_bucket((value % U64(buckets)).astype(np.int64)):  # by text still
                    head, count = runs(text[x])
                    cells = pack6(value[x]), np.packbits(multi[x]).tobytes(), text[x][head].tobytes(), count.astype("<u4").tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), *[pa.array([c], pa.binary()) for c in cells]], names)

    def decide(group: pa.Table) -> pa.Table:
        hashes, multi, texts = [], [], []
        for h, m, t, c in zip(*(group[n].to_pylist() for n in ("hashes", "multi", "texts", "counts")), strict=True):
            hashes.append(unpack6(h))
            multi.append(np.unpackbits(np.frombuffer(m, np.uint8), count=len(hashes[-1])).astype(bool))
            texts.append(np.repeat(np.frombuffer(t, "<i8"), np.frombuffer(c, "<u4")))
        hashes, flags, texts = np.concatenate(hashes), np.concatenate(multi), np.concatenate(texts)
        found = []
        for x in _portions((hashes // U64(buckets)), -(-len(hashes) // DECIDE_ENTRIES)):
            value, multi, text = hashes[x], flags[x], texts[x]
            order = np.lexsort((text, value))
            value, multi, text = value[order], multi[order], text[order]
            at, sizes = runs(value)
            repeated = np.logical_or.reduceat(multi, at)
            repeated |= (sizes > 1) if scheme.within else (text[at] != text[at + sizes - 1])
            # Copies of a text, of other slices, say the same: one entry of them is left.
            again = np.repeat(repeated, sizes)
            again[1:] &= (value[1:] != value[:-1]) | (text[1:] != text[:-1])
            mode = np.where(np.add.reduceat(again.astype(np.int64), at) > MANY, SINGLE, STRING).astype(np.uint8)
            found.append((text[again], value[again], np.repeat(mode, sizes)[again]))
        del hashes, flags, texts
        text, value, mode = (np.concatenate(x) for x in zip(*found, strict=True))
        # A row per group of texts, so that rows follow neither texts nor buckets.
        to = (text.view(U64) % U64(buckets)).astype(np.int64)
        out = {"group": [], "texts": [], "hashes": [], "modes": []}
        for number, x in _by_bucket(to) if len(to) else ():
            for name, cell in zip(out, (number, text[x].tobytes(), pack6(value[x]), mode[x].tobytes()), strict=True):
                out[name].append(cell)
        return pa.table({n: pa.array(v, pa.int64() if n == "group" else pa.binary()) for n, v in out.items()})

    def gather(group: pa.Table) -> pa.Table:
        text, mode = (np.frombuffer(b"".join(group[n].to_pylist()), t) for n, t in (("texts", "<i8"), ("modes", "u1")))
        value = unpack6(b"".join(group["hashes"].to_pylist()))
        order = np.argsort(text, kind="stable")
        text, value, mode = text[order], value[order], mode[order]
        head, count = runs(text)
        spans = [(a, a + n) for a, n in zip(head.tolist(), count.tolist(), strict=True)]
        return pa.table({
            "text": pa.array(text[head], pa.int64()), "hashes": pa.array([pack6(value[a:b]) for a, b in spans], pa.binary()),
            "modes": pa.array([mode[a:b].tobytes() for a, b in spans], pa.binary()),
        })

    packed = docs.select("tid", "text").mapInArrow(tidy(emit), kinds)
    decided = packed.groupBy("bucket").applyInArrow(tidy_group(decide), "group long, texts binary, hashes binary, modes binary")
    return decided.groupBy("group").applyInArrow(tidy_group(gather), "text long, hashes binary, modes binary")


_CELLS = ["strings", "lengths", "parts", "keys", "texts", "firsts", "counts", "multi", "found"]
_STRINGS = "bucket long, " + ", ".join(f"{c} binary" for c in _CELLS)
_OWNED = np.dtype([("text", "<i8"), ("first", "<u4"), ("mask", "<u8")])


def _full(counts: np.ndarray) -> np.ndarray:
    return (U64(0xFFFFFFFFFFFFFFFF) >> (U64(64) - counts.astype(U64))).astype(U64)


def travelling(docs: DataFrame, scheme: Scheme, buckets: int) -> DataFrame:
    """Strings of flagged windows, packed by bucket. ``docs`` has ``key, uid, hashes,
    modes, ztext``, one row per distinct text."""
    size = scheme.window

    def emit(batches):
        pack = zstandard.ZstdCompressor(level=3)

        def row(bucket, *cells):
            cells = [pack.compress(c) if c else b"" for c in cells]
            return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), *[pa.array([c], pa.binary()) for c in cells]], ["bucket", *_CELLS])

        for batch in batches:
            keys, uids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, hi, raw, borders in unzipped(batch.column(4)):
                symbols, cuts, starts, ends = scheme.symbols(raw, borders)
                own, places, least, hashes = minimisers(symbols, cuts, size, scheme.k)
                cells = batch.column(2).slice(lo, hi - lo).to_pylist()
                flag = unpack6(b"".join(cells))
                mode = np.frombuffer(b"".join(batch.column(3).slice(lo, hi - lo).to_pylist()), np.uint8)
                if not len(own) or not len(flag):
                    continue
                # The flags of each row, found by row and hash.
                flag = flag ^ _salt(np.repeat(np.arange(hi - lo), [len(c) // 6 for c in cells]))
                order = np.argsort(flag, kind="stable")
                flag, mode = flag[order], mode[order]
                at, count = runs(own, least)
                mine = hashes[at] ^ _salt(own[at])
                spot = np.minimum(np.searchsorted(flag, mine), len(flag) - 1)
                hit = np.repeat(flag[spot] == mine, count)
                how = np.repeat(mode[spot], count)
                for single in (False, True):
                    x = np.flatnonzero(hit & (how == (SINGLE if single else STRING)))
                    if not len(x):
                        continue
                    if single:
                        head, c = x, np.ones(len(x), np.int64)
                    else:
                        head, c = runs(own[x], least[x], x - np.arange(len(x)))
                        head = x[head]
                    r, f = own[head], places[head]
                    tail = f + c + size - 1
                    d1, d2 = (span_hashes(symbols, f, tail, i) for i in (0, 1))
                    # Buckets of their own for single windows: a document may send both.
                    deal = d1 & _MASK if single else hashes[head]
                    to = (deal % U64(buckets)).astype(np.int64) + (buckets if single else 0)
                    part = (deal >> U64(40)).astype(np.uint8)
                    key, text, begin = keys[lo:hi][r], uids[lo:hi][r], (f - cuts[r]).astype(np.uint32)
                    # Equal strings of the slice: one travels, by the smallest key.
                    order = np.lexsort((key, d2, d1))
                    at, members = runs(d1[order], d2[order])
                    if scheme.within:
                        settled = np.repeat(members > 1, members)
                        send = np.zeros(len(order), bool)
                        send[at] = True
                    else:
                        settled = key[order] != np.repeat(key[order[at]], members)
                        send = ~settled
                    sure = order[settled]
                    found = np.empty(len(sure), _OWNED)
                    found["text"], found["first"], found["mask"] = text[sure], begin[sure], _full(c[sure])
                    multi = np.zeros(len(order), np.uint8)
                    multi[order[settled]] = 1
                    go = np.sort(order[send])  # by document
                    first, last = starts[f], ends[tail - 1]
                    for bucket, y in _by_bucket(to[go]):
                        y = go[y]
                        length = last[y] - first[y]
                        yield row(
                            bucket, raw[ranges(first[y], length)].tobytes(), length.astype("<u4").tobytes(), part[y].tobytes(), key[y].astype("<i8").tobytes(),
                            text[y].astype("<i8").tobytes(), begin[y].astype("<u4").tobytes(), c[y].astype("u1").tobytes(), multi[y].tobytes(), b"",
                        )
                    if len(found):
                        yield row(int(to[0]), *[b""] * 8, found.tobytes())

    return docs.select("key", "uid", "hashes", "modes", "ztext").mapInArrow(tidy(emit), _STRINGS)


def _salt(rows: np.ndarray) -> np.ndarray:
    return rows.astype(U64) * U64(0x9E3779B97F4A7C15)


@dataclass
class Bucket:
    """Strings end to end with their borders; per string the key of its document, its
    number of windows and whether it is known to occur twice."""

    raw: np.ndarray
    borders: np.ndarray
    keys: np.ndarray
    counts: np.ndarray
    multi: np.ndarray


def found_windows(strings: DataFrame, scheme: Scheme) -> DataFrame:
    """``uid, found``: windows of each text that repeat, as packed cells."""

    def settle(group: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor()

        def cell(name, kind):
            return np.frombuffer(b"".join(unpack.decompress(x) for x in group[name].to_pylist() if x), kind)

        lengths = cell("lengths", "<u4").astype(np.int64)
        owned = [cell("found", _OWNED)]
        if len(lengths):
            keys, counts = cell("keys", "<i8"), cell("counts", "u1").astype(np.int64)
            raw, multi, starts = cell("strings", np.uint8), cell("multi", "u1") > 0, np.cumsum(lengths) - lengths
            masks = np.zeros(len(lengths), U64)
            for x in _portions(cell("parts", np.uint8).astype(U64), -(-len(raw) // JUDGE_BYTES)):
                n = counts[x]
                bucket = Bucket(raw[ranges(starts[x], lengths[x])], np.concatenate([[0], np.cumsum(lengths[x])]), keys[x], n, multi[x])
                again = scheme.judge(bucket)  # one flag per window, string by string
                heads = np.cumsum(n) - n
                bit = np.arange(len(again)) - np.repeat(heads, n)
                masks[x] = np.add.reduceat(again.astype(U64) << bit.astype(U64), heads)
            some = masks > 0
            out = np.empty(int(some.sum()), _OWNED)
            out["text"], out["first"], out["mask"] = cell("texts", "<i8")[some], cell("firsts", "<u4")[some], masks[some]
            owned.append(out)
        rows = np.concatenate(owned)
        order, heads = _groups(rows["text"])
        rows = rows[order]
        packed = np.empty(len(rows), _FOUND)
        packed["first"], packed["mask"] = rows["first"], rows["mask"]
        ends = np.append(heads[1:], len(rows))[: len(heads)].tolist()
        cells = [packed[a:b].tobytes() for a, b in zip(heads.tolist(), ends, strict=True)]
        return pa.table({"uid": pa.array(rows["text"][heads].astype(np.int64)), "found": pa.array(cells, pa.binary())})

    return strings.groupBy("bucket").applyInArrow(tidy_group(settle), "uid long, found binary")


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished steps: it does once the
    driver's Python, and then its JVM, have collected the frames that held them. The
    link between the two hands over what Python has dropped about once a second."""
    for _ in range(2):
        gc.collect()
        time.sleep(1.5)
        spark.sparkContext._jvm.System.gc()


def repeated_windows(documents: DataFrame, scheme: Scheme) -> DataFrame:
    """``key, tid, copies, found`` for the first document (smallest key) of each
    distinct text; rows of ``documents`` without one are later copies of a text."""
    spark = documents.sparkSession
    docs = prepared(documents)
    firsts = docs.groupBy("tid").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("copies"), F.max(F.octet_length("text")).alias("size"))
    # A number of its own tells each text from then on, whatever ids are null or repeated.
    firsts = cut_lineage(firsts.withColumn("short", _short_column("tid")).withColumn("uid", F.monotonically_increasing_id()), "texts")
    size = firsts.agg(F.sum("size")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES)
    flags = cut_lineage(flagged_minimisers(docs, scheme, parts), "flags")
    release_shuffles(spark)
    chosen = firsts.join(flags, firsts["short"] == flags["text"]).select("key", "tid", "uid", "hashes", "modes")
    texts = zipped(docs).join(chosen, ["key", "tid"])
    found = found_windows(travelling(texts, scheme, 2 * parts), scheme)
    gathered = found.groupBy("uid").agg(F.collect_list("found").alias("found"))
    out = cut_lineage(firsts.join(gathered, "uid", "left").select("key", "tid", "copies", "found"), "found")
    del found, gathered, texts, chosen
    release_shuffles(spark)
    return out


def _short_column(tid: str):
    """What ``_short`` gives, as a column: eight bytes, the first the lowest."""
    out = F.lit(0).cast("long")
    for i in range(8):
        byte = F.conv(F.hex(F.substring(F.col(tid), i + 1, 1)), 16, 10).cast("long")
        out = out.bitwiseOR(F.shiftleft(byte, 8 * i))
    return out


def with_windows(documents: DataFrame, scheme: Scheme) -> DataFrame:
    """``row`` (all columns but the text), ``is_null``, ``ztext``, ``copies`` and ``found``
    of every document; ``copies`` is null for later copies of a text."""
    found = repeated_windows(documents, scheme)
    rest = F.struct(*[F.col(f"`{c}`") for c in documents.columns if c != "text"])
    rows = documents.select(rest.alias("row"), "doc_id", "text", F.col("text").isNull().alias("is_null"))
    return zipped(prepared(rows, "row", "is_null")).join(found, ["key", "tid"], "left").select("row", "is_null", "ztext", "copies", "found")


def original_columns(documents: DataFrame):
    """The columns of ``documents`` out of ``row`` and ``text``."""
    return [F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in documents.columns]


def window_starts(cells: list[bytes] | None) -> np.ndarray:
    """First symbols of the windows in a document's cells."""
    found = np.frombuffer(b"".join(cells or []), _FOUND)
    if not len(found):
        return np.zeros(0, np.int64)
    bits = np.unpackbits(np.ascontiguousarray(found["mask"]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, bit = np.nonzero(bits)
    return found["first"][row].astype(np.int64) + bit
