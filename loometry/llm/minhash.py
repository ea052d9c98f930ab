"""Near-duplicate documents by b-bit MinHash, confirmed on full shingle sets.

Documents with the same set are one node. A node keeps a byte of each of its mixed
minima; packed bytes serve as band keys, and the bit count of two signatures'
difference estimates their similarity. Nodes of a bucket meet the bucket's centre
first; once the links found so far are joined into components, only pairs of a
bucket that lie in different components are looked at, so that no group is ever
paired out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loometry.llm.arrays import LOWER, NOT_SPACE, U64, mix, ranges, span_hashes, text_slices, tidy, words
from loometry.session import cut_lineage

SHINGLE = 3
#: Bytes of text worked on at once.
SLICE = 1 << 19
#: Bands by default. A pair of similarity s shares none of n bands with probability
#: (1 - s^5)^n: 7e-9 at 0.85 with 32, 5e-9 at 0.8 with 48.
BANDS, ROWS, BITS = 32, 5, 8
#: Estimates this far below the threshold are not looked at further. The
#: estimate's deviation is below 0.035 at 0.8 and above, so this is over five of them.
SLACK = 0.2
#: One-bit lanes of the finer signature. For sets of similarity s its estimate has a
#: deviation of sqrt((1 - s^2) / FINE), whatever their sizes, as the lanes' bits are
#: independent of one another; pairs are given so many deviations.
FINE = 2048
FINE_DEVIATIONS = 6
_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(0, 1 << 32, FINE, np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, FINE, np.uint32)


def shingle_sets(raw: np.ndarray, borders: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows, sorted within a row, and row borders.
    A row of fewer words has its whole sequence as one shingle, one of none nothing."""
    raw = LOWER[raw]
    starts, ends, cuts = words(raw, borders, NOT_SPACE)
    hashes = span_hashes(raw, starts, ends)
    counts = np.diff(cuts)
    number = np.where(counts == 0, 0, np.maximum(counts - size + 1, 1))
    first = ranges(cuts[:-1], number)
    rows = np.repeat(np.arange(len(counts)), number)
    last = np.minimum(first + size, cuts[rows + 1])
    value = span_hashes(hashes, first, last)
    order = np.lexsort((value, rows))
    value, rows = value[order], rows[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (rows[1:] != rows[:-1])
    return value[keep], np.searchsorted(rows[keep], np.arange(len(borders)))


def digests(sets: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, from sums that do not depend on an order."""
    out = []
    for salt in (0x1B873593A4093822, 0x299F31D0082EFA98):
        total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(sets ^ U64(salt)), dtype=U64)])
        out.append(mix(total[cuts[1:]] - total[cuts[:-1]]).view(np.int64))
    return out[0], out[1]


def _stir(x: np.ndarray) -> np.ndarray:
    """Mix 32-bit values, so that their low bits depend on all of the value's."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def _minima(sets: np.ndarray, cuts: np.ndarray, lanes: int, bits: int) -> np.ndarray:
    """Bits of the mixed minima, a row of ``lanes`` for each set (empty: zeros).

    A minimum's own low bits are a function of the shingle's low bits: the lowest one
    is the same for all lanes up to a constant. Mixed, they differ from lane to lane.
    """
    some = np.flatnonzero(np.diff(cuts) > 0)
    out = np.zeros((len(cuts) - 1, lanes), np.uint8)
    if not len(some):
        return out
    x, heads = (sets >> U64(32)).astype(np.uint32), cuts[:-1][some]
    for lane in range(lanes):
        out[some, lane] = _stir(np.minimum.reduceat(x * _A[lane] + _B[lane], heads)) & np.uint32((1 << bits) - 1)
    return out


def signatures(sets: np.ndarray, cuts: np.ndarray, bands: int = BANDS) -> np.ndarray:
    return _minima(sets, cuts, bands * ROWS, BITS)


def fine_signatures(sets: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """One bit of each of many minima, packed."""
    return np.packbits(_minima(sets, cuts, FINE, 1), axis=1)


def _longs(packed: np.ndarray) -> pa.Array:
    values = np.ascontiguousarray(packed).view("<i8")
    offsets = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()))


def document_sets(documents: DataFrame, *, shingle: int = SHINGLE, bands: int = BANDS) -> DataFrame:
    """``doc_id, n, d1, d2, sig`` of every row: the size of its set, 128 bits that tell
    it, and its signature as longs."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, borders in text_slices(batch.column(1), SLICE):
                sets, cuts = shingle_sets(raw, borders, shingle)
                d1, d2 = digests(sets, cuts)
                cells = [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(cuts)), pa.array(d1), pa.array(d2), _longs(signatures(sets, cuts, bands))]
                yield pa.RecordBatch.from_arrays(cells, ["doc_id", "n", "d1", "d2", "sig"])

    schema = "doc_id long, n long, d1 long, d2 long, sig array<long>"
    return documents.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(tidy(run), schema)


def band_keys(sig: str, bands: int) -> Column:
    """Array of the signature's band keys, five bytes each under the band's number."""
    keys = []
    for band in range(bands):
        at, shift = divmod(band * ROWS, 8)
        low = F.shiftrightunsigned(F.col(sig)[at], 8 * shift)
        if shift + ROWS > 8:
            low = low.bitwiseOR(F.shiftleft(F.col(sig)[at + 1], 8 * (8 - shift)))
        keys.append(low.bitwiseAND(F.lit((1 << 40) - 1)).bitwiseOR(F.lit(band << 40)))
    return F.array(*keys)


def estimate(a: str, b: str, longs: int) -> Column:
    """Similarity from the differing bits of two signatures: lanes that differ have
    half their bits differ, so a share s of equal minima leaves (1 - s) / 2 of the
    bits; that corrects for minima whose low bits agree by chance."""
    bits = sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(longs)), F.lit(0))
    return F.lit(1.0) - bits.cast("double") * (2.0 / (64 * longs))


def fine_estimate(a: str, b: str) -> Column:
    """As ``estimate``, over the bits of the finer signatures. They are counted by a
    loop: written out, the compiled code of a join would be longer than the JVM
    compiles, and every pair would be interpreted."""
    differing = F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    bits = F.aggregate(differing, F.lit(0), lambda x, y: x + y)
    return F.lit(1.0) - bits.cast("double") * (2.0 / FINE)


def fine_cut(a: str, b: str, percent: int) -> Column:
    """The lowest fine estimate of linked sets of these sizes: from the smallest
    similarity of ``percent`` or more that their sizes allow, less the deviations."""
    both = F.col(a) + F.col(b)
    common = F.ceil(both * percent / (100 + percent) - 1e-9)
    least = common / (both - common)
    return least - FINE_DEVIATIONS * F.sqrt(F.greatest(1 - least * least, F.lit(0.0)) / FINE)


def _zip(texts: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(texts)


def node_texts(documents: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """``node, ztext``: the compressed text of one document of each node."""
    needed = nodes.select("node", F.col("node.rep").alias("rep"), F.col("node.d1").alias("d1"))
    texts = documents.select(F.col("doc_id").cast("long").alias("rep"), F.coalesce("text", F.lit("")).alias("text"))
    both = texts.join(needed.select("rep", "d1"), "rep")

    def run(batches):
        for batch in batches:
            for lo, hi, raw, borders in text_slices(batch.column(1), SLICE):
                sets, cuts = shingle_sets(raw, borders, shingle)
                d1, _ = digests(sets, cuts)
                same = np.flatnonzero(d1 == batch.column(2).slice(lo, hi - lo).to_numpy())
                data = raw.tobytes()
                cells = [_zip(data[borders[i] : borders[i + 1]]) for i in same.tolist()]
                rep = batch.column(0).slice(lo, hi - lo).take(pa.array(same))
                yield pa.RecordBatch.from_arrays([rep, pa.array(d1[same]), pa.array(cells, pa.binary())], ["rep", "d1", "ztext"])

    zipped = both.mapInArrow(tidy(run), "rep long, d1 long, ztext binary")
    return zipped.groupBy("rep", "d1").agg(F.first("ztext").alias("ztext")).select(F.struct("rep", "d1").alias("node"), "ztext")


def fine_estimates(texts: DataFrame, shingle: int) -> DataFrame:
    """``node, fine``: the finer signature of each text."""

    def run(batches):
        plain = zstandard.ZstdDecompressor()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                held = [plain.decompress(x) for x in part.column(1).to_pylist()]
                raw = np.frombuffer(b"".join(held), np.uint8)
                sets, cuts = shingle_sets(raw, np.concatenate([[0], np.cumsum([len(x) for x in held])]), shingle)
                yield pa.RecordBatch.from_arrays([part.column(0), _longs(fine_signatures(sets, cuts))], ["node", "fine"])

    return texts.select("node", "ztext").mapInArrow(tidy(run), "node struct<rep:long,d1:long>, fine array<long>")


def confirmed(texts: DataFrame, pairs: DataFrame, percent: int, shingle: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets have 100 * intersection >= percent * union."""
    left = pairs.join(texts.select(F.col("node").alias("a"), F.col("ztext").alias("ta")), "a")
    both = left.join(texts.select(F.col("node").alias("b"), F.col("ztext").alias("tb")), "b").select("a", "b", "ta", "tb")

    def run(batches):
        plain = zstandard.ZstdDecompressor()
        for batch in batches:
            step = 512
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                columns, sizes = [], []
                for cell in (part.column(2), part.column(3)):
                    texts = [plain.decompress(x) for x in cell.to_pylist()]
                    raw = np.frombuffer(b"".join(texts), np.uint8)
                    sets, cuts = shingle_sets(raw, np.concatenate([[0], np.cumsum([len(x) for x in texts])]), shingle)
                    sizes.append(np.diff(cuts))
                    columns.append((np.repeat(np.arange(part.num_rows), np.diff(cuts)), sets))
                rows = np.concatenate([columns[0][0], columns[1][0]])
                values = np.concatenate([columns[0][1], columns[1][1]])
                order = np.lexsort((values, rows))
                rows, values = rows[order], values[order]
                twice = (values[1:] == values[:-1]) & (rows[1:] == rows[:-1])
                common = np.bincount(rows[1:][twice], minlength=part.num_rows)
                linked = 100 * common >= percent * (sizes[0] + sizes[1] - common)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(linked)), part.column(1).filter(pa.array(linked))], ["a", "b"])

    kind = "struct<rep:long,d1:long>"
    return both.mapInArrow(tidy(run), f"a {kind}, b {kind}")


def components(links: DataFrame) -> DataFrame:
    """``node, label``: the smallest node that each linked node reaches.

    Every round takes the smallest label among the neighbours and then the label of
    that label, until nothing changes; each round is a table in the shared folder.
    """
    edges = cut_lineage(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = cut_lineage(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        closer = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        following = closer.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label"))
        following = cut_lineage(following, "labels")
        changed = following.filter("label != old").limit(1).count()
        labels = following.select("node", "label")
        if not changed:
            return labels


def near_duplicates(documents: DataFrame, *, percent: int = 85, shingle: int = SHINGLE, bands: int = BANDS) -> DataFrame:
    """``doc_id, n, d1, d2, component_id, is_node``, one row per document.

    Sets are the distinct shingles (of three words by default) of the lower-cased text. Rows of one
    set are copies of each other; ``is_node`` marks the row(s) that stand for their
    whole component. Null and empty texts have no set and are linked with nothing,
    as are rows without an id. Repeated rows have the same result.
    """
    rows = cut_lineage(document_sets(documents, shingle=shingle, bands=bands), "sets")
    real = rows.filter("n > 0 AND doc_id IS NOT NULL")
    nodes = cut_lineage(
        real.groupBy("n", "d1", "d2", "sig").agg(F.min("doc_id").alias("rep"))
        .select(F.struct("rep", "d1").alias("node"), "n", "d1", "d2", "sig"), "nodes",
    )
    banded = nodes.select("node", F.explode(band_keys("sig", bands)).alias("bucket"))
    sizes = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    shared = cut_lineage(banded.join(sizes, "bucket"), "shared")
    # A bucket's centre is its member that meets the most others over all of its buckets:
    # of a family of edited copies that is one with few edits, which most are like.
    meets = shared.groupBy("node").agg(F.sum("k").alias("meets"))
    order = F.struct("meets", F.xxhash64("node").alias("h"), "node")
    centres = shared.select("node", "bucket").join(meets, "node").groupBy("bucket").agg(F.max(order).alias("c"))
    centres = centres.select("bucket", F.col("c.node").alias("centre"), F.col("c.meets").alias("meets"), F.col("c.h").alias("h"))
    members = cut_lineage(shared.select("node", "bucket").join(centres, "bucket"), "buckets")

    # The text of one document of each node that shares a bucket moves once.
    texts = cut_lineage(node_texts(documents, members.select("node").distinct(), shingle), "texts")

    # Every node meets one centre first, the one that meets the most: most of a family
    # meets the same one. What is then in another component than a centre meets that one too.
    signed = nodes.select("node", "sig", "n")
    longs, cut = bands * ROWS // 8, percent / 100 - SLACK
    one = members.groupBy("node").agg(F.max(F.struct("meets", "h", "centre"))["centre"].alias("b"))
    pairs = one.filter("node != b").select(F.col("node").alias("a"), "b")
    links = cut_lineage(confirmed(texts, cut_lineage(_plausible(pairs, signed, longs, cut, percent), "pairs"), percent, shingle), "links")
    labels = components(links)
    here = members.filter("node != centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
    for side in ("a", "b"):
        here = here.join(labels.select(F.col("node").alias(side), F.col("label").alias(f"l{side}")), side, "left").withColumn(f"l{side}", F.coalesce(f"l{side}", side))
    pairs = cut_lineage(_plausible(here.filter("la != lb").select("a", "b"), signed, longs, cut, percent), "pairs")
    links = cut_lineage(links.unionAll(confirmed(texts, pairs, percent, shingle)), "links")
    labels = components(links)

    # What is left: pairs of a bucket in two components. They are looked at with the
    # finer signature, and those that may be alike on their full sets.
    labelled = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")).drop("centre", "meets", "h")
    mixed = labelled.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.mode("label").alias("main")).filter("low != high")
    open_rows = cut_lineage(labelled.join(mixed.select("bucket", "main"), "bucket"), "mixed")
    fine = cut_lineage(fine_estimates(texts.join(open_rows.select("node").distinct(), "node", "left_semi"), shingle), "fine")
    left = open_rows.join(fine.join(nodes.select("node", "n", band_keys("sig", bands).alias("keys")), "node"), "node")
    minor = left.filter("label != main").select("bucket", F.col("node").alias("a"), F.col("label").alias("la"), F.col("fine").alias("fa"), F.col("n").alias("na"), F.col("keys").alias("ka"))
    others = left.select("bucket", F.col("node").alias("b"), F.col("label").alias("lb"), F.col("fine").alias("fb"), F.col("n").alias("nb"), F.col("keys").alias("kb"), "main")
    close = _sizes_fit("na", "nb", percent) & (fine_estimate("fa", "fb") >= fine_cut("na", "nb", percent))
    # Of two minor ones, one order is enough.
    once = (F.col("lb") == F.col("main")) | (F.col("a") < F.col("b"))
    # A pair meets in the first bucket that both are in, and in no other.
    first = F.array_intersect("ka", "kb")[0] == minor["bucket"]
    rest = minor.join(others, (minor["bucket"] == others["bucket"]) & (F.col("la") != F.col("lb")) & once & close & first).select("a", "b")
    rest = cut_lineage(rest, "rest")
    if rest.limit(1).count():
        links = cut_lineage(links.unionAll(confirmed(texts, rest, percent, shingle)), "links")
        labels = components(links)

    known = nodes.select("n", "d1", "d2", "node").join(labels, "node", "left").select("n", "d1", "d2", "node", F.coalesce("label", "node").alias("label"))
    base = rows.drop("sig")
    alone = base.filter("n = 0 OR doc_id IS NULL").select("doc_id", "n", "d1", "d2", F.col("doc_id").alias("component_id"), F.lit(True).alias("is_node"))
    joined = base.filter("n > 0 AND doc_id IS NOT NULL").join(known, ["n", "d1", "d2"]).select(
        "doc_id", "n", "d1", "d2", F.col("label.rep").alias("component_id"),
        ((F.col("node") == F.col("label")) & (F.col("doc_id") == F.col("node.rep"))).alias("is_node"),
    )
    return alone.unionAll(joined)


def _sizes_fit(a: str, b: str, percent: int) -> Column:
    """Sets of too different sizes can not reach the similarity."""
    return (F.least(a, b) * 100 >= F.greatest(a, b) * percent)


def _plausible(pairs: DataFrame, signed: DataFrame, longs: int, cut: float, percent: int) -> DataFrame:
    left = pairs.join(signed.select(F.col("node").alias("a"), F.col("sig").alias("sa"), F.col("n").alias("na")), "a")
    both = left.join(signed.select(F.col("node").alias("b"), F.col("sig").alias("sb"), F.col("n").alias("nb")), "b")
    return both.filter(_sizes_fit("na", "nb", percent) & (estimate("sa", "sb", longs) >= cut)).select("a", "b")


def remove_near_duplicates(documents: DataFrame, *, percent: int = 85, shingle: int = SHINGLE, bands: int = BANDS) -> DataFrame:
    """One document of each component, the one with the smallest id, with its columns.
    Documents without a set or an id stay; of repeated rows one stays."""
    columns = documents.columns
    # The text goes to Python and back once.
    rest = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in columns if c != "text"])
    packed = documents.select(F.col("doc_id").cast("long"), "text", rest.alias("row"))
    kept = near_duplicates(documents, percent=percent, shingle=shingle, bands=bands).filter("is_node AND n > 0 AND doc_id IS NOT NULL").select("doc_id", "d1", "d2").distinct()

    def add(batches):
        for batch in batches:
            for lo, hi, raw, borders in text_slices(batch.column(1), SLICE):
                sets, cuts = shingle_sets(raw, borders, shingle)
                d1, d2 = digests(sets, cuts)
                own = (batch.column(i).slice(lo, hi - lo) for i in range(3))
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.diff(cuts)), pa.array(d1), pa.array(d2)], ["doc_id", "text", "row", "n", "d1", "d2"])

    kinds = {f.name: f.dataType.simpleString() for f in packed.schema}
    rows = packed.mapInArrow(tidy(add), f"doc_id long, text {kinds['text']}, row {kinds['row']}, n long, d1 long, d2 long")
    whole = rows.filter("n = 0 OR doc_id IS NULL").select("text", "row")
    chosen = rows.filter("n > 0").join(kept, ["doc_id", "d1", "d2"], "left_semi").dropDuplicates(["doc_id", "d1", "d2"]).select("text", "row")
    return whole.unionAll(chosen).select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in columns])
