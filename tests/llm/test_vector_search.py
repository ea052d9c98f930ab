"""Top-k search against all scores."""

from __future__ import annotations

import math

import numpy as np
import pytest

from loometry.llm import vector_search
from loometry.llm.queries import QUERIES, table
from loometry.llm.vector_search import top_k, usable, whole_numbers


def plain(vectors, queries, k):
    out = []
    for qid, q in queries:
        scores = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in vectors if i != qid)
        out += [(qid, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


def test_query_matches_all_scores(spark, data_dir):
    rows = [(r.vec_id, [math.floor(256 * float(x)) for x in r.embedding]) for r in table(spark, data_dir, "embeddings").collect()]
    assert got(QUERIES["op6_vector_search"](spark, data_dir)) == plain(rows, [r for r in rows if r[0] % 50 == 0], 5)


@pytest.mark.parametrize("pass_queries,block,pivots,sample", [(8192, 1024, 48, 2048), (7, 16, 3, 10), (1, 1, 1, 2)])
def test_ties_copies_and_small_blocks(spark, monkeypatch, pass_queries, block, pivots, sample):
    for name, value in (("PASS_QUERIES", pass_queries), ("BLOCK_ROWS", block), ("PIVOTS", pivots), ("SAMPLE", sample)):
        monkeypatch.setattr(vector_search, name, value)
    rng = np.random.default_rng(0)
    rows = [(i, rng.integers(-9, 10, 4).tolist()) for i in range(120)] + [(i, [5, 5, 5, 5]) for i in range(200, 280)] + [(i, [0, 0, 0, 0]) for i in range(300, 310)]
    vectors = spark.createDataFrame(rows, "vec_id long, vector array<long>").repartition(3)
    queries = [r for r in rows if r[0] % 20 == 0]
    assert got(top_k(vectors, vectors.filter("vec_id % 20 = 0"), 5)) == plain(rows, queries, 5)


def test_odd_rows(spark):
    rows = [(1, [1.0, 2.0]), (2, None), (None, [1.0, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [None, 1.0]), (6, [-0.001, 0.5]), (6, [-0.001, 0.5]), (7, [1.0])]
    raw = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    vectors = raw.filter(usable(raw["embedding"])).select("vec_id", whole_numbers(raw["embedding"]).alias("vector"))
    real = [(1, [256, 512]), (6, [-1, 128]), (6, [-1, 128]), (7, [256])]
    assert got(top_k(vectors, vectors, 5)) == plain(real, [(1, [256, 512]), (6, [-1, 128]), (7, [256])], 5)
    assert top_k(vectors.limit(0), vectors.limit(0)).count() == 0
