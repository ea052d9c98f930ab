"""Range joins against a nested loop."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from loometry.operators import ranges
from loometry.operators.ranges import counts_around, interval_join
from loometry.plans import catalog


def brute(intervals, points):
    return sorted((a, p) for a, k, lo, hi in intervals for p, q, t in points if k == q and None not in (k, lo, hi, t) and lo <= t <= hi)


def frames(spark, intervals, points):
    return spark.createDataFrame(intervals, "a long, k string, lo long, hi long"), spark.createDataFrame(points, "p long, k string, t long")


@pytest.mark.parametrize("seed", [1, 2])
def test_random_intervals(spark, seed):
    rng = random.Random(seed)
    widths = [0, 1, 7, 8, 1000, 10**6, 1 << 40]
    intervals = []
    for i in range(200):
        lo = rng.randint(-5000, 5000)
        intervals.append((i, rng.choice(["x", "y", None]), rng.choice([lo, lo, lo, None]), lo + rng.choice([-1, *widths])))
    points = [(i, rng.choice(["x", "y", None]), rng.choice([None, rng.randint(-6000, 6000), rng.randint(-50, 50)])) for i in range(300)]
    left, right = frames(spark, intervals, points)
    got = interval_join(left, right, low="lo", high="hi", at="t", keys=["k"], cell_points=9)
    assert sorted((r.a, r.p) for r in got.collect()) == brute(intervals, points)
    assert sorted(got.columns) == ["a", "hi", "k", "lo", "p", "t"]


def test_repeated_rows_and_no_rows(spark):
    left, right = frames(spark, [(1, "x", 0, 5)] * 2 + [(2, "x", 9, 3)], [(7, "x", 5)] * 3)
    got = interval_join(left, right, low="lo", high="hi", at="t", keys=["k"])
    assert [(r.a, r.p) for r in got.collect()] == [(1, 7)] * 6
    assert interval_join(left.limit(0), right, low="lo", high="hi", at="t", keys=["k"]).count() == 0
    assert interval_join(left, right.limit(0), low="lo", high="hi", at="t", keys=["k"]).count() == 0


def test_too_long_is_refused(spark):
    left, right = frames(spark, [(1, "x", -(1 << 62) - 1, 1 << 62)], [(7, "x", 5)])
    with pytest.raises(Exception, match="too long|overflow|OVERFLOW"):
        interval_join(left, right, low="lo", high="hi", at="t", keys=["k"]).collect()


def test_no_nested_loop_and_a_hot_cell_is_dealt_out(spark, data_dir):
    plan = catalog.QUERIES["q3_events_around_purchases"](spark, data_dir)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    # Neither sent whole nor put together again for being small here.
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        points = spark.range(40_000).select(F.col("id").alias("p"), F.when(F.col("id") % 3 == 0, 500).otherwise(F.col("id")).cast("long").alias("t"))
        left = spark.createDataFrame([(1, 490, 510)], "a long, lo long, hi long")
        got = interval_join(left, points, low="lo", high="hi", at="t", cell_points=500)
        assert got.count() == 13_334 + 14
        # One cell holds a third of all points; no task gets them all.
        assert got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 8000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def plain_counts(rows, reach):
    out = {}
    for key, kind, _, t in rows:
        for other, _, who, s in rows if kind == "c" and None not in (key, t) else ():
            if None not in (other, s) and other != key and abs(s - t) <= reach:
                n, whos = out.setdefault(key, (0, set()))
                out[key] = n + 1, whos | {who}
    return sorted((k, n, len(whos - {None})) for k, (n, whos) in out.items())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_counts_around_like_a_nested_loop(spark, seed):
    rng = random.Random(seed)
    span = 400 if seed < 3 else 30000
    rows = [(i, rng.choice("cx"), rng.choice([None, *range(8)]), rng.choice([None, *[rng.randrange(span)] * 9])) for i in range(150)]
    rows += rng.choices(rows, k=20) + [(rng.choice([None, *range(10)]), rng.choice("cx"), rng.randrange(8), rng.randrange(span)) for _ in range(15)]
    df = spark.createDataFrame(rows, "key long, kind string, who long, t long")
    got = counts_around(df, 10, key="key", at="t", who="who", centre=F.col("kind") == "c")
    assert sorted(tuple(r) for r in got.collect()) == plain_counts(rows, 10) != []
    assert counts_around(df.limit(0), 10, key="key", at="t", who="who", centre=F.col("kind") == "c").count() == 0


def test_counts_around_forms_no_pairs(spark):
    """20,000 rows at one time are 400,000,000 pairs; in steps they are two."""
    df = spark.range(20_000).select(F.col("id").alias("key"), F.lit("c").alias("kind"), (F.col("id") % 50).alias("who"), F.lit(5).cast("long").alias("t"))
    seen = []
    real = ranges.interval_join

    def counted(left, right, **names):
        out = real(left, right, **names)
        seen.append(out.count())
        return out

    ranges.interval_join = counted
    try:
        got = ranges.counts_around(df, 10, key="key", at="t", who="who", centre=F.col("kind") == "c")
        assert got.agg(F.min("events"), F.max("events"), F.min("users"), F.count("*")).first()[:] == (19_999, 19_999, 50, 20_000)
    finally:
        ranges.interval_join = real
    assert sum(seen) <= 20_000
