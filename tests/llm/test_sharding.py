"""Sharding: the law, gapless slots, few moves, even shares."""

from __future__ import annotations

import zlib
from collections import Counter

from pyspark.sql import functions as F

from loometry.llm.queries import QUERIES, table
from loometry.llm.sharding import assign, shard_documents


def test_query(spark, data_dir):
    texts = {r.doc_id: (r.text or "").encode() for r in table(spark, data_dir, "documents").collect()}
    rows = QUERIES["op3_rendezvous_sharding"](spark, data_dir).collect()
    assert len(rows) == len(texts)
    slots = {}
    for r in rows:
        assert r["size"] == len(texts[r.doc_id]) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id])
        assert r.law == "key" and 0 <= r.shard < 40 and r.grown_shard in (r.shard, 40)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_growth_and_weights(spark):
    rows = spark.range(20000)
    before = assign(rows, "id", 5)
    after = assign(rows, "id", 6).select("id", F.col("shard").alias("next"))
    both = before.join(after, "id").collect()
    assert all(r.grown_shard == r.next and r.next in (r.shard, 5) for r in both)
    assert 2900 < sum(r.next == 5 for r in both) < 3800
    weighted = Counter(r.shard for r in assign(rows, "id", 3, weights=[1, 1, 2]).collect())
    assert 9500 < weighted[2] < 10500


def test_nulls_repeats_and_clashing_columns(spark):
    rows = spark.createDataFrame(
        [(1, None, 1), (1, None, 2), (None, "é", 3), (None, None, 4), (2, "", 5)] + [(None, "x", 6)] * 50,
        "doc_id long, text string, shard int",
    )
    found = shard_documents(rows, 3).collect()
    assert len(found) == 55 and {r["size"] for r in found} == {16, 17, 18}
    slots = {}
    for r in found:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r.shard for r in found if r.doc_id is None}) == 1
    assert shard_documents(rows.limit(0)).count() == 0


def test_no_python_in_the_plan(spark, data_dir):
    df = QUERIES["op3_rendezvous_sharding"](spark, data_dir)
    text = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "Python" not in text and "Arrow" not in text
