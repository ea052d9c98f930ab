"""Chunked scans equal plain windows, whatever the chunk size and the skew."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loometry.operators.ranking import exact_quantile, ranked
from loometry.operators.scans import chunk_of, consecutive_ids, first_rows, one_row, scan, with_value_chunk
from loometry.operators.timeline import asof_last, clip_gaps


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows; a third of the values are null."""
    return spark.range(3000).select(
        F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id") % 7).alias("k"), "id",
        F.when(F.hash("id") % 3 != 0, F.hash("id") % 100).alias("v"),
    )


@pytest.mark.parametrize("rows", [1, 37, 5000])
def test_scan_equals_window(skewed, rows):
    v = F.col("v")
    got = scan(
        skewed, ["k"], ["id"], chunk_of("id", rows), number="n", counts={"c": v > 10}, sums={"s": v},
        last={"l": v}, before={"b": v}, after={"a": v},
    )
    w = Window.partitionBy("k").orderBy("id")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = skewed.select(
        "*", F.row_number().over(w).cast("long").alias("n"), F.count_if(v > 10).over(upto).alias("c"),
        F.coalesce(F.sum("v").over(upto), F.lit(0)).alias("s"), F.last("v", True).over(upto).alias("l"),
        F.lag("v").over(w).alias("b"), F.lead("v").over(w).alias("a"),
    )
    assert got.exceptAll(want).count() == 0
    assert want.exceptAll(got).count() == 0


def test_scan_with_null_key(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "k string, id long")
    got = {r["id"]: r["n"] for r in scan(df, ["k"], ["id"], chunk_of("id", 1), number="n").collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_value_chunks_ignore_outliers(spark):
    df = spark.range(10000).select(F.when(F.col("id") == 0, 1e15).otherwise(F.col("id").cast("double")).alias("v"))
    sizes = [r["count"] for r in with_value_chunk(df, "v", chunks=50).groupBy("_bucket").count().collect()]
    assert len(sizes) >= 45 and max(sizes) < 500


def test_value_chunk_of_nothing(spark):
    assert consecutive_ids(spark.range(0), "id", 5, name="new").count() == 0


def test_consecutive_ids(spark):
    sparse = spark.range(500).select((F.col("id") * 7919 % 100003).alias("at"))
    got = consecutive_ids(sparse, "at", 100).orderBy("at").collect()
    assert [r["id"] for r in got] == list(range(100, 600))


def test_first_rows_and_one_row(skewed):
    got = first_rows(skewed, ["k"], [F.col("id")], 3).collect()
    expected = {}
    for r in skewed.orderBy("id").collect():
        expected.setdefault(r["k"], []).append(r["id"])
    assert sorted((r["k"], r["id"]) for r in got) == sorted((k, i) for k, ids in expected.items() for i in ids[:3])
    latest = {r["k"]: r["id"] for r in one_row(skewed, ["k"], [F.col("id")], latest=True).collect()}
    assert latest == {k: ids[-1] for k, ids in expected.items()}


@pytest.fixture(autouse=True)
def many_chunks(spark):
    """Small partitions stay apart, so that there is something to carry."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, before)


def test_consecutive_ids_by_date_and_text(spark):
    """Any orderable type will do."""
    rows = spark.range(300).select(F.date_add(F.lit("2020-01-01"), F.col("id").cast("int")).alias("day"), F.format_string("%05d", "id").alias("name"))
    for column in ("day", "name"):
        got = consecutive_ids(rows, column, 0).orderBy(column).collect()
        assert [r["id"] for r in got] == list(range(300))


@pytest.mark.parametrize("nulls", [False, True])
def test_ranked(skewed, nulls):
    """Null values and null keys rank as well; one key and one value hold most rows."""
    df = skewed.select(F.when(~F.lit(nulls) | (F.col("k") < 5), F.col("k")).alias("k"), "id", F.when(F.col("id") % 5 < 3, 7).otherwise(F.col("v")).alias("v"))
    df = df if nulls else df.filter("v is not null")
    got = ranked(df, ["k"], "v", "id", tiles=4)
    w = Window.partitionBy("k").orderBy("v", "id")
    by_value = Window.partitionBy("k").orderBy("v")
    want = df.select(
        *got.columns[:0], "k", "v", "id", F.row_number().over(w).cast("long").alias("row_number"),
        F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("running_sum"),
        F.lag("v").over(w).alias("previous"), F.lead("v").over(w).alias("following"),
        F.rank().over(by_value).cast("long").alias("rank"), F.dense_rank().over(by_value).cast("long").alias("dense_rank"),
        F.ntile(4).over(w).cast("long").alias("ntile"),
    ).select(*got.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


@pytest.mark.parametrize("keys", [["k"], []])
def test_exact_quantile(skewed, keys):
    skewed = skewed.withColumn("k", F.when(F.col("k") < 5, F.col("k")))
    got = exact_quantile(skewed, keys, "v", [0.0, 0.3, 1.0])
    want = skewed.groupBy(*keys).agg(F.percentile("v", F.lit(0.3)).alias("p"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    rows = {tuple(r[k] for k in keys): r for r in want.collect()}
    for r in got.collect():
        expected = rows[tuple(r[k] for k in keys)]
        assert r["q_0_3"] == pytest.approx(expected["p"])
        assert (r["q_0_0"], r["q_1_0"]) == (expected["lo"], expected["hi"])
    assert got.count() == len(rows)


@pytest.mark.parametrize("strict", [False, True])
def test_asof_brute_force(spark, strict):
    left = [(k, t) for k in "ab" for t in range(0, 60, 3)]
    right = [(k, t, f"{k}{t}") for k in "ab" for t in range(1 if k == "a" else 30, 60, 4)]
    lf = spark.createDataFrame(left, "k string, t long")
    rf = spark.createDataFrame(right, "k string, at long, name string")
    got = asof_last(
        lf, rf, keys=["k"], left_time="t", right_time="at", value=F.col("name"), name="found", strict=strict
    )
    for r in got.collect():
        fits = [x for x in right if x[0] == r["k"] and (x[1] < r["t"] if strict else x[1] <= r["t"])]
        assert r["found"] == (max(fits, key=lambda x: x[1])[2] if fits else None)
    assert got.count() == len(left)


def test_clip_gaps(spark):
    clips = spark.createDataFrame(
        [
            (1, 0, 2.0, 3.0),   # first clip of the track starts at 2.0
            (2, 0, 4.0, 0.5),   # overlaps: negative gap, not reported
            (3, 0, 5.0, 1.0),   # measured from the end of clip 2 (4.5), not of clip 1 (5.0)
            (4, 1, 0.005, 1.0), # within the tolerance
            (5, 1, 1.505, 1.0),
        ],
        "clip_id long, track_index long, start_time double, duration double",
    ).withColumn("start_us", (F.col("start_time") * 1e6).cast("long"))
    got = {r["clip_id"]: round(r["gap"], 6) for r in clip_gaps(clips).collect()}
    assert got == {1: 2.0, 3: 0.5, 5: 0.5}


def test_hot_key_is_spread_even_if_partitioned_by_key(spark):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        hot = spark.range(4000).select(F.lit("hot").alias("k"), "id").repartition(8, "k")
        out = scan(hot, ["k"], ["id"], chunk_of("id", 100), number="n")
        assert out.select(F.spark_partition_id().alias("p")).distinct().count() > 4
        assert out.filter("n <> id + 1").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
