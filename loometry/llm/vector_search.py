"""Exact top-k inner products with a pivot-distance index.

Vectors are keyed by their nearest pivot and their distance to it, and lie in
blocks, each an annulus around its pivot. A query visits a task's blocks from the
most promising on and stops where no block left can beat its k-th score: the
triangle inequality bounds the distance to an annulus, and with the largest norm
in the block the inner product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loometry.session import cut_lineage

#: Vectors, first in hash order, among which pivots are chosen and first scores found.
SAMPLE = 2048
PIVOTS = 48
BLOCK_ROWS = 1024
#: Queries that a task holds at once; more take further passes over the index.
PASS_QUERIES = 8192
#: Bounds are computed in doubles; so much, relative, they are widened.
SLACK = 1e-9


def whole_numbers(vector: Column) -> Column:
    """floor(256 x) of every component."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("long"))


def usable(vector: Column) -> Column:
    """Neither null nor with a component that is null or not finite."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of a list column; shorter ones are filled up with zeros."""
    borders = column.offsets.to_numpy()
    values = column.values[borders[0] : borders[-1]].to_numpy(zero_copy_only=False)
    sizes = np.diff(borders)
    width = int(sizes.max(initial=0)) if width is None else width
    out = np.zeros((len(sizes), width))
    rows = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(values)) - np.repeat(borders[:-1] - borders[0], sizes)
    out[rows, at] = values
    return out


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Each next pivot is the vector farthest from those chosen."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    chosen = [0]
    far = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(count, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0))


_BLOCK = "pivot int, low double, high double, norm double, ids binary, vectors binary"


def build_index(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Blocks of the vectors (``vec_id, vector``), written to the shared folder."""
    width = pivots.shape[1]
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    def key(batches):
        for batch in batches:
            far = distances(matrix(batch.column(1), width), shared.value)
            near = far.argmin(1) if len(far) else np.zeros(0, int)
            cells = [pa.array(near, pa.int32()), pa.array(far[np.arange(len(near)), near]), batch.column(0), batch.column(1)]
            yield pa.RecordBatch.from_arrays(cells, ["pivot", "distance", "vec_id", "vector"])

    keyed = vectors.mapInArrow(key, "pivot int, distance double, vec_id long, vector array<long>")
    order = ["pivot", "distance", "vec_id"]

    def pack(batches):
        for batch in batches:
            pivot, far, ids = (batch.column(i).to_numpy() for i in range(3))
            numbers = matrix(batch.column(3), width)
            cuts = np.flatnonzero(np.diff(pivot)) + 1
            for part in np.split(np.arange(len(ids)), cuts):
                for lo in range(0, len(part), BLOCK_ROWS):
                    rows = part[lo : lo + BLOCK_ROWS]
                    v = numbers[rows]
                    cells = (int(pivot[rows[0]]), float(far[rows].min()), float(far[rows].max()), float(np.sqrt((v**2).sum(1).max())), ids[rows].astype("<i8").tobytes(), v.astype("<i8").tobytes())
                    kinds = (pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds, strict=True)], [x.split()[0] for x in _BLOCK.split(", ")])

    return cut_lineage(keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pack, _BLOCK), "annuli")


@dataclass
class Queries:
    ids: np.ndarray
    vectors: np.ndarray
    far: np.ndarray  # distances to the pivots
    floor: np.ndarray  # a score that k candidates are known to reach
    start: int  # number of the first


def upper_bounds(queries: Queries, pivot: np.ndarray, low: np.ndarray, high: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """Largest inner product of each query with anything in each block.

    2 q.x = |q|^2 + |x|^2 - |q - x|^2, and |q - x| is at least the gap between the
    query's distance to the pivot and the annulus.
    """
    far = queries.far[:, pivot]
    gap = np.maximum(np.maximum(low - far, far - high), 0)
    length = np.sqrt((queries.vectors**2).sum(1))[:, None]
    # |x| may be less than the block's largest; both |x| and |q - x| vary, so the
    # bound by |q| |x| holds beside it.
    by_gap = (length**2 + norm**2 - gap**2) / 2
    bound = np.minimum(by_gap, length * norm)
    return bound + SLACK * (length**2 + norm**2 + 1)


def best(owner: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each owner: high scores, then small ids."""
    order = np.lexsort((ids, -score, owner))
    heads = np.flatnonzero(np.concatenate([[True], owner[order][1:] != owner[order][:-1]])) if len(order) else np.zeros(0, int)
    rank = np.arange(len(order)) - np.repeat(heads, np.diff(np.append(heads, len(order))))
    return order[rank < k]


def search_blocks(queries: Queries, blocks: list[dict], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query number, id and score of the best candidates in some blocks."""
    stats = [np.array([b[n] for b in blocks]) for n in ("pivot", "low", "high", "norm")]
    bound = upper_bounds(queries, *stats)
    floor = queries.floor.copy()
    top = np.full((len(floor), k), -np.inf)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    width = queries.vectors.shape[1]
    for i in np.argsort(-bound.max(0)):
        alive = np.flatnonzero(bound[:, i] >= floor)
        if not len(alive):
            continue
        ids = np.frombuffer(blocks[i]["ids"], "<i8")
        numbers = np.frombuffer(blocks[i]["vectors"], "<i8").reshape(-1, width).astype(float)
        score = queries.vectors[alive] @ numbers.T
        score[queries.ids[alive][:, None] == ids[None, :]] = -np.inf
        cut = min(k, len(ids))
        part = np.partition(score, len(ids) - cut, axis=1)[:, len(ids) - cut :]
        top[alive] = np.sort(np.concatenate([top[alive], part], 1), 1)[:, -k:]
        floor[alive] = np.maximum(floor[alive], top[alive, 0])
        row, column = np.nonzero((score >= floor[alive][:, None]) & (score > -np.inf))
        owner, value, which = alive[row], score[row, column], ids[column]
        keep = best(owner, value, which, k)
        found.append((owner[keep], which[keep], value[keep]))
    owner, ids, score = (np.concatenate(x) for x in zip(*found, strict=True))
    keep = best(owner, score, ids, k)
    return owner[keep], ids[keep], score[keep]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k largest inner products of each query.

    Both tables have ``vec_id`` and ``vector`` (whole numbers below 2^20 or so: sums
    stay exact in doubles). Ties go to the smaller id. Rows with the query's own id are
    no candidates; other repeated rows each count. Vectors of unequal length are
    compared as if the shorter went on with zeros. Rows with a null id or vector take
    no part. Each distinct query row is answered once.
    """
    spark = vectors.sparkSession
    vectors = vectors.filter("vec_id IS NOT NULL AND vector IS NOT NULL").select(F.col("vec_id").cast("long"), F.col("vector").cast("array<long>"))
    queries = queries.filter("vec_id IS NOT NULL AND vector IS NOT NULL").select(F.col("vec_id").cast("long"), F.col("vector").cast("array<long>"))
    width = vectors.unionAll(queries).agg(F.max(F.size("vector"))).first()[0] or 0
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow().combine_chunks()
    ids = sample["vec_id"].to_numpy()
    numbers = matrix(sample["vector"].combine_chunks(), width) if len(ids) else np.zeros((0, width))
    pivots = choose_pivots(numbers, PIVOTS)
    index = build_index(vectors, pivots)
    found = spark.createDataFrame([], "number long, query_id long, vec_id long, score long")
    for block in query_passes(queries.distinct(), width, ids, numbers, pivots, k):
        found = found.unionAll(_one_pass(index, block, k))
    order = Window.partitionBy("number").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def query_passes(queries: DataFrame, width: int, ids: np.ndarray, sample: np.ndarray, pivots: np.ndarray, k: int) -> Iterator[Queries]:
    """Queries in blocks of bounded size, with the scores that the sample guarantees."""

    def block(rows: list, start: int) -> Queries:
        vectors = np.zeros((len(rows), width))
        for i, row in enumerate(rows):
            vectors[i, : len(row[1])] = row[1]
        own = np.array([r[0] for r in rows], np.int64)
        score = vectors @ sample.T
        score[own[:, None] == ids[None, :]] = -np.inf
        floor = np.full(len(rows), -np.inf)
        if score.shape[1] >= k:
            floor = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
        return Queries(own, vectors, distances(vectors, pivots), floor, start)

    rows, start = [], 0
    for row in queries.toLocalIterator():
        rows.append(row)
        if len(rows) == PASS_QUERIES:
            yield block(rows, start)
            rows, start = [], start + len(rows)
    if rows:
        yield block(rows, start)


def _one_pass(index: DataFrame, queries: Queries, k: int) -> DataFrame:
    shared = index.sparkSession.sparkContext.broadcast(queries)

    def run(batches):
        for batch in batches:
            owner, ids, score = search_blocks(shared.value, batch.to_pylist(), k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(owner + shared.value.start), pa.array(shared.value.ids[owner]), pa.array(ids), pa.array(score.astype(np.int64))],
                ["number", "query_id", "vec_id", "score"],
            )

    return index.mapInArrow(run, "number long, query_id long, vec_id long, score long")
