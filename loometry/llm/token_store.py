"""Token ids in shards of raw numbers, with a minimal perfect hash index.

Layout of a store, all Parquet, written by Spark's own committers:

``payload``  one row per block: ``shard``, ``block``, numbers of documents and ids,
             ``ids`` (raw little-endian numbers of ``width`` bytes, whole
             documents end to end, each closed by id 0) and ``frames`` (key, null flag
             and length of each document). Shards, blocks and documents ascend by key.
``index``    one row per bucket of keys: a minimal perfect hash, and for each of its
             slots a fingerprint of the key, where its ids begin and how many they are.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loometry.llm.arrays import U64, mix, text_slices
from loometry.llm.memo import WordIds
from loometry.session import cut_lineage

#: Ids of a block, about; a longer document has a block of its own.
BLOCK_IDS = 1 << 18
#: Keys of an index bucket, about.
BUCKET_KEYS = 1 << 15
#: Bits per open key in each level of the hash.
_LOAD = 2
END = 0
_ENCODERS: dict[str, WordIds] = {}
#: White space that may follow a space, or the first byte of a character that may be.
_NOT_AFTER = np.zeros(256, bool)
_NOT_AFTER[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0xC2, 0xE1, 0xE2, 0xE3]] = True


def encoder(tokenizer_file: str) -> WordIds:
    """The byte-level tokenizer of the file, once per worker process."""
    if tokenizer_file not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_file)

        def encode_words(words: list[str]) -> list[list[int]]:
            out = []
            for i in range(0, len(words), 4096):
                out += [e.ids for e in tokenizer.encode_batch_fast(words[i : i + 4096], add_special_tokens=False)]
            return out

        _ENCODERS[tokenizer_file] = WordIds(encode_words)
    return _ENCODERS[tokenizer_file]


def token_ids(memo: WordIds, raw: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of whole texts. The tokenizer splits a text before every space that
    something other than white space follows, so parts between such places can be
    encoded one by one (a part that could hold a special token is left whole with
    its neighbours by none: special tokens hold no space)."""
    cut = np.zeros(len(raw), bool)
    cut[:-1] = (raw[:-1] == 32) & ~_NOT_AFTER[raw[1:]]
    cut[borders[:-1][borders[:-1] < len(raw)]] = True
    # A space that ends a row has nothing after it there.
    last = borders[1:-1] - 1
    last = last[(last >= 0) & (last < len(raw))]
    starts_row = np.isin(last, borders[:-1])
    cut[last[(raw[last] == 32) & ~starts_row]] = False
    return memo.encode(raw, borders, np.flatnonzero(cut))


def key_hash(keys: np.ndarray, nulls: np.ndarray) -> np.ndarray:
    return mix(mix(keys.astype(np.int64).view(U64) + U64(0x9E3779B97F4A7C15)) + nulls.astype(U64))


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> U64(32)) % U64(buckets)).astype(np.int64)


class PerfectHash:
    """Levels of bits: a key takes the first level where no other open key falls on
    its bit; its number is the rank of that bit among all set bits."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes = sizes
        self.base = np.cumsum(sizes) - sizes
        self.set = np.unpackbits(bits, count=int(sizes.sum()), bitorder="little").astype(bool)
        self.rank = np.cumsum(self.set) - 1

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        sizes, levels, level = [], [], 0
        while len(hashes):
            size = _LOAD * len(hashes)
            at = cls._place(hashes, level, size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            sizes.append(size)
            hashes, level = hashes[~alone[at]], level + 1
            if level > 200:
                raise ValueError("two keys of a bucket have the same hash")
        bits = np.packbits(np.concatenate(levels), bitorder="little") if levels else np.zeros(0, np.uint8)
        return cls(np.array(sizes, np.int64), bits)

    @staticmethod
    def _place(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(hashes + U64((level * 0xA24BAED4963EE407 + 1) % (1 << 64))) % U64(size)).astype(np.int64)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each key; -1 for most keys that are not in the set."""
        out = np.full(len(hashes), -1, np.int64)
        left = np.arange(len(hashes))
        for level, size in enumerate(self.sizes.tolist()):
            at = self.base[level] + self._place(hashes[left], level, size)
            here = self.set[at]
            out[left[here]] = self.rank[at[here]]
            left = left[~here]
            if not len(left):
                break
        return out


def _frames(keys: np.ndarray, nulls: np.ndarray, lengths: np.ndarray) -> bytes:
    return keys.astype("<i8").tobytes() + lengths.astype("<u4").tobytes() + nulls.astype(np.uint8).tobytes()


def _read_frames(cell: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(cell) // 13
    return (
        np.frombuffer(cell, "<i8", n), np.frombuffer(cell, np.uint8, n, 12 * n).astype(bool), np.frombuffer(cell, "<u4", n, 8 * n).astype(np.int64),
    )


_PAYLOAD = "shard int, block int, n_docs long, n_ids long, width int, frames binary, ids binary"


def write(documents: DataFrame, tokenizer_file: str, path: str, *, key: str = "doc_id", text: str = "text") -> None:
    """Encode ``text`` and write a store at ``path``.

    Keys are whole numbers; null keys come first. Rows of one key stand together, by
    a hash of their text; the index gives the first and their number. Null and empty
    texts have the end id only. An empty table makes an empty store.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col(f"`{key}`").cast("long").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    # The hash keeps a key with very many rows from filling one shard.
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("key", "tie").sortWithinPartitions("key", "tie")

    def blocks(batches) -> Iterator[pa.RecordBatch]:
        memo, shard, block = encoder(tokenizer_file), TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = 0

        def flush():
            keys, nulls, lengths, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            width = 2 if ids.max() < 1 << 16 else 4
            return pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in (
                    (shard, pa.int32()), (block, pa.int32()), (len(keys), pa.int64()), (len(ids), pa.int64()), (width, pa.int32()),
                    (_frames(keys, nulls, lengths), pa.binary()), (ids.astype(f"<u{width}").tobytes(), pa.binary()))],
                ["shard", "block", "n_docs", "n_ids", "width", "frames", "ids"],
            )

        for batch in batches:
            nulls = np.array(batch.column(0).is_null())
            keys = batch.column(0).fill_null(0).to_numpy()
            for lo, hi, raw, borders in text_slices(batch.column(1), 1 << 20):
                ids, counts = token_ids(memo, raw, borders)
                ids = np.insert(ids, np.cumsum(counts), END)
                held.append((keys[lo:hi], nulls[lo:hi], counts + 1, ids))
                size += len(ids)
                if size >= BLOCK_IDS:
                    yield flush()
                    held, size, block = [], 0, block + 1
        if held:
            yield flush()

    rows.select("key", "text").mapInArrow(blocks, _PAYLOAD).write.option("compression", "zstd").parquet(f"{path}/payload")
    _write_index(spark, path)


def _places(spark: SparkSession, path: str) -> DataFrame:
    """Blocks with ``first``, the number of ids before them. Sums over shards, then blocks."""
    blocks = spark.read.schema(_PAYLOAD).parquet(f"{path}/payload")
    within = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("all")).select("shard", F.coalesce(F.sum("all").over(over), F.lit(0)).alias("base"))
    small = blocks.select("shard", "block", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("inner"))
    firsts = small.join(shards, "shard").select("shard", "block", (F.col("inner") + F.col("base")).alias("first"))
    return firsts


def _entries(spark: SparkSession, path: str) -> DataFrame:
    """One row per stored document, read from the frames: ``key, shard, block, offset, n_ids``."""

    def unpack(batches):
        for batch in batches:
            for row in batch.to_pylist():
                keys, nulls, lengths = _read_frames(row["frames"])
                cells = [pa.array(np.full(len(keys), row["shard"], np.int32)), pa.array(np.full(len(keys), row["block"], np.int32)),
                         pa.array(keys, mask=nulls), pa.array(np.cumsum(lengths) - lengths), pa.array(lengths)]
                yield pa.RecordBatch.from_arrays(cells, ["shard", "block", "key", "offset", "n_ids"])

    blocks = spark.read.schema(_PAYLOAD).parquet(f"{path}/payload").select("shard", "block", "frames")
    return blocks.mapInArrow(unpack, "shard int, block int, key long, offset long, n_ids long")


_INDEX = "bucket long, buckets long, sizes binary, bits binary, fingerprints binary, shards binary, blocks binary, offsets binary, lengths binary, copies binary"


def _write_index(spark: SparkSession, path: str) -> None:
    total = spark.read.schema(_PAYLOAD).parquet(f"{path}/payload").agg(F.sum("n_docs")).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_KEYS))
    first = _entries(spark, path).groupBy("key").agg(
        F.min(F.struct("shard", "block", "offset", "n_ids")).alias("at"), F.count(F.lit(1)).alias("copies")
    )

    def bucketed(batches):
        for batch in batches:
            hashes = key_hash(batch.column(0).fill_null(0).to_numpy(), np.array(batch.column(0).is_null()))
            yield pa.RecordBatch.from_arrays([pa.array(bucket_of(hashes, buckets)), pa.array(hashes.view(np.int64)), *batch.columns[1:]], names)

    names = ["bucket", "hash", "shard", "block", "offset", "n_ids", "copies"]
    rows = first.select("key", "at.*", "copies").mapInArrow(bucketed, "bucket long, hash long, shard int, block int, offset long, n_ids long, copies long")

    def build(table: pa.Table) -> pa.Table:
        hashes = table["hash"].to_numpy().view(U64)
        hashed = PerfectHash.build(hashes)
        slot = hashed.slots(hashes)
        back = np.argsort(slot)

        def cell(values, kind):
            return values[back].astype(kind).tobytes()

        at = {n: table[n].to_numpy() for n in ("shard", "block", "offset", "n_ids", "copies")}
        return pa.Table.from_pylist([{
            "bucket": table["bucket"][0].as_py(), "buckets": buckets, "sizes": hashed.sizes.astype("<i8").tobytes(),
            "bits": np.packbits(hashed.set, bitorder="little").tobytes(), "fingerprints": cell(hashes & U64(0xFFFFFFFF), "<u4"),
            "shards": cell(at["shard"], "<u4"), "blocks": cell(at["block"], "<u4"), "offsets": cell(at["offset"], "<u8"),
            "lengths": cell(at["n_ids"], "<u4"), "copies": cell(at["copies"], "<u8"),
        }], schema=_arrow_schema())

    rows.groupBy("bucket").applyInArrow(build, _INDEX).write.option("compression", "zstd").parquet(f"{path}/index")


def _arrow_schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in _INDEX.split(", "))])


def locate(keys: DataFrame, path: str, *, key: str = "doc_id") -> DataFrame:
    """Where the documents of the given distinct keys begin: ``key, shard, block,
    offset, n_ids, copies``. A key that is not stored has no row (up to one in 2^32
    of those that fall on a set bit: fingerprints have 32 bits)."""
    spark = keys.sparkSession
    index = spark.read.schema(_INDEX).parquet(f"{path}/index")
    head = index.select("buckets").first()
    buckets = head[0] if head else 1
    wanted = keys.select(F.col(f"`{key}`").cast("long").alias("key")).distinct()

    def bucketed(batches):
        for batch in batches:
            hashes = key_hash(batch.column(0).fill_null(0).to_numpy(), np.array(batch.column(0).is_null()))
            yield pa.RecordBatch.from_arrays([pa.array(bucket_of(hashes, buckets)), batch.column(0)], ["bucket", "key"])

    wanted = wanted.mapInArrow(bucketed, "bucket long, key long")
    out = pa.schema([("key", pa.int64()), ("shard", pa.int32()), ("block", pa.int32()), ("offset", pa.int64()), ("n_ids", pa.int64()), ("copies", pa.int64())])

    def look(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return out.empty_table()
        row = right.slice(0, 1).to_pylist()[0]
        hashed = PerfectHash(np.frombuffer(row["sizes"], "<i8"), np.frombuffer(row["bits"], np.uint8))
        keys = left["key"].combine_chunks()
        hashes = key_hash(keys.fill_null(0).to_numpy(), np.array(keys.is_null()))
        slot = hashed.slots(hashes)
        ok = slot >= 0
        ok[ok] = np.frombuffer(row["fingerprints"], "<u4")[slot[ok]] == (hashes[ok] & U64(0xFFFFFFFF)).astype(np.uint32)
        at = slot[ok]
        cells = [np.frombuffer(row[n], k)[at] for n, k in (("shards", "<u4"), ("blocks", "<u4"), ("offsets", "<u8"), ("lengths", "<u4"), ("copies", "<u8"))]
        kinds = [np.int32, np.int32, np.int64, np.int64, np.int64]
        return pa.Table.from_arrays([keys.filter(pa.array(ok)), *[pa.array(c.astype(k)) for c, k in zip(cells, kinds, strict=True)]], schema=out)

    return wanted.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInArrow(
        look, "key long, shard int, block int, offset long, n_ids long, copies long"
    )


def _cut(places: DataFrame, path: str, name: str, kind: pa.DataType, value) -> DataFrame:
    """``value`` of the stored ids at each place (``key, shard, block, offset, n_ids``).

    Places meet their block once, block by block: a task holds one block and the
    places inside it, which are no more than the block has ids. A place that reaches
    beyond its block is an error.
    """
    blocks = places.sparkSession.read.schema(_PAYLOAD).parquet(f"{path}/payload").select("shard", "block", "n_ids", "width", "ids")
    names = ["key", "shard", "block", "offset", "n_ids"]

    def inside(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.select(names)
        if left.num_rows and not right.num_rows:
            raise ValueError("the index names a block that is not stored")
        found = []
        if left.num_rows:
            block = right.slice(0, 1).to_pylist()[0]
            ids = np.frombuffer(block["ids"], f"<u{block['width']}", block["n_ids"])
            for at, n in zip(left["offset"].to_numpy().tolist(), left["n_ids"].to_numpy().tolist(), strict=True):
                if at < 0 or at + n > len(ids):
                    raise ValueError("the index reaches beyond its block")
                found.append(value(ids[at : at + n]))
        return left.append_column(name, pa.array(found, kind))

    shown = {pa.int64(): "long"}.get(kind, "array<long>")
    met = places.select(*names).groupBy("shard", "block").cogroup(blocks.groupBy("shard", "block"))
    return met.applyInArrow(inside, f"key long, shard int, block int, offset long, n_ids long, {name} {shown}")


def fetch(keys: DataFrame, path: str, *, key: str = "doc_id") -> DataFrame:
    """``key, ids``: the stored ids, end id included, of the first document of each key."""
    ids = _cut(locate(keys, path, key=key), path, "ids", pa.list_(pa.int64()), lambda found: found.astype(np.int64))
    return ids.select("key", "ids")


def digests(keys: DataFrame, path: str, *, key: str = "doc_id") -> DataFrame:
    """Per stored document of the keys: ``key, start, n_tokens, ids_crc32``.

    Shard, block, offset and length come from the index, and the ids that stand there
    are digested. Of a key with several documents the index knows the first place and
    their number; the further ones are those that the frames name after it.
    """
    spark = keys.sparkSession
    first = cut_lineage(locate(keys, path, key=key), "located")
    place = ["key", "shard", "block", "offset", "n_ids"]
    repeated = first.filter("copies > 1").select(*[F.col(c).alias(f"l_{c}") for c in place])
    later = F.struct("shard", "block", "offset") > F.struct("l_shard", "l_block", "l_offset")
    more = _entries(spark, path).join(repeated, F.col("key").eqNullSafe(F.col("l_key")) & later)
    found = _cut(
        first.select(*place).unionByName(more.select(*place)), path, "ids_crc32", pa.int64(),
        lambda ids: zlib.crc32(ids.astype("<u4").tobytes()),
    )
    return found.join(_places(spark, path), ["shard", "block"]).select(
        "key", (F.col("first") + F.col("offset")).alias("start"), F.col("n_ids").alias("n_tokens"), "ids_crc32"
    )
