"""Sketches of days and totals that follow changes."""

from __future__ import annotations

import datetime as dt
import glob

from pyspark.sql import functions as F

from loometry.operators import summaries as su
from loometry.session import shared_dir
from loometry.sources.keyed import KeyedTable

SCHEMA = "id long, user_email string, mime_type string, num_media long, generation_time double, created_at timestamp, deleted_at timestamp, deleted_by long"


def media(spark, n=4000):
    day = dt.datetime(2024, 1, 1)
    rows = [
        (i, f"u{i * 7919 % 1700}" if i % 50 else None, ["image/png", "video/mp4", "audio/wav", "text/plain", None][i % 5], None if i % 13 == 0 else i % 4,
         float(i * 31 % 997), None if i % 401 == 0 else day + dt.timedelta(hours=i % 240), day if i % 17 == 0 else None, None)
        for i in range(n)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_merged_sketches_are_near(spark):
    items = media(spark)
    live = items.filter("deleted_at IS NULL AND created_at IS NOT NULL")
    sketches = su.day_sketches(items)
    assert sketches.count() == 10
    row = su.distinct_users(su.merged_sketches(sketches), "estimate").withColumn("median", su.measure_quantile(0.5)).first()
    exact = live.agg(F.countDistinct("user_email"), F.count(F.lit(1))).first()
    assert row["items"] == exact[1] and abs(row["estimate"] - exact[0]) <= 4 * su.HLL_ERROR * exact[0]
    assert abs(live.filter(F.col("generation_time") <= row["median"]).count() / exact[1] - 0.5) <= su.KLL_ERROR + 0.01
    assert su.day_sketches(items.limit(0)).count() == 0


def same(report, table):
    return sorted(map(tuple, report.read().collect())) == sorted(map(tuple, su.day_totals(table.read()).collect()))


def test_totals_follow_changes(spark):
    items = media(spark, 1000)
    table = KeyedTable.create(items, shared_dir(spark, "media"), ["id"], buckets=8)
    report = su.DailyMedia.create(items, shared_dir(spark, "report"))
    assert same(report, table)
    some = spark.createDataFrame([(5,), (6,), (29,)], "id long")
    report.change(table, some, lambda: table.soft_delete(some, F.lit(dt.datetime(2024, 2, 2)), by=1))
    assert same(report, table)
    assert spark.read.parquet(*glob.glob(f"{report.table.path}/changes/v=1/*/*.parquet")).count() == 2
    report.change(table, some, lambda: table.restore(some))
    assert same(report, table)
    copies = table.rows(some).withColumn("id", F.col("id") + 5000).withColumn("created_at", F.lit(dt.datetime(2025, 5, 5)))
    report.change(table, copies, lambda: table.upsert(copies))
    assert same(report, table) and report.read().filter("date = '2025-05-05'").first()["items"] == 3
    report.change(table, copies, lambda: table.hard_delete(spark.createDataFrame([(5005,), (5006,), (5029,)], "id long")))
    assert same(report, table) and report.read().filter("date = '2025-05-05'").count() == 0
