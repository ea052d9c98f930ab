"""Changes to bucketed tables, and joins on ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from loometry.operators import changes as ch
from loometry.operators import summaries
from loometry.operators.ranges import counts_around
from loometry.plans.registry import ORACLE, query
from loometry.plans.streams import progress_stream
from loometry.plans.upkeep import keys, now, stamp
from loometry.session import cut_lineage, shared_dir
from loometry.sources.keyed import KeyedTable
from loometry.streaming.streams import run_batches


def _media(m) -> KeyedTable:
    rows = m.media_items.select("id", "workspace_id", "status", "prompt", "created_at", "deleted_at", "deleted_by")
    return KeyedTable.create(rows, shared_dir(m.spark, "media"), ["id"])


@query("m1_keyed_soft_delete", ORACLE["m1_soft_delete"])
def m1(m):
    table = _media(m)
    table.soft_delete(keys(m, 5), now(), by=42)
    return table.read().select("id", stamp("deleted_at"), F.coalesce("deleted_by", F.lit(-1)).alias("deleted_by"))


@query("m1_keyed_restore", ORACLE["m1_restore"])
def m1_restore(m):
    table = _media(m)
    table.soft_delete(keys(m, 5), now(), by=42)
    table.restore(keys(m, 5))
    table.compact()
    return table.read().select("id", stamp("deleted_at"), F.coalesce("deleted_by", F.lit(-1)).alias("deleted_by"))


@query("m2_keyed_hard_delete", "SELECT id, workspace_id FROM media_items WHERE id NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 4 = 0)")
def m2(m):
    table = _media(m)
    table.hard_delete(keys(m, 4))
    return table.read().select("id", "workspace_id")


@query("m4_keyed_stop_stuck_jobs", ORACLE["m4_stop_stuck_jobs"])
def m4(m):
    table, when = _media(m), F.lit("1999-01-01 01:00:00").cast("timestamp")
    table.change_where(ch.is_stuck(when), lambda rows: ch.stop_stuck_jobs(rows, when))
    return table.read().groupBy("status").agg(F.count(F.lit(1)).alias("count"))


@query("m7_keyed_upsert", ORACLE["m7_upsert"])
def m7(m):
    table = KeyedTable.create(m.feedback_requests, shared_dir(m.spark, "requests"), ["briefing_id", "market"])
    table.upsert(m.tickets.filter("status = 'open'").select("briefing_id", "market").distinct().withColumn("review_state", F.lit("in_review")))
    return table.read().select("briefing_id", "market", "review_state", F.coalesce("token_hash", F.lit("")).alias("token_hash"))


@query("st1_keyed_progress", ORACLE["st1_latest_progress"])
def st1(m):
    stream, path = progress_stream(m), shared_dir(m.spark, "st1")
    table = KeyedTable.create(m.spark.createDataFrame([], stream.schema), f"{path}/table", ["report_id"])
    run_batches(stream, f"{path}/checkpoint", table.merge_latest(["ts", "event_id"]))
    return table.read().select("report_id", "event_id", "author", "kind", "text")


@query("q3_events_around_purchases", """
SELECT p.event_id, count(*) AS events, count(DISTINCT e.user_id) AS users FROM events p
JOIN events e ON e.ts BETWEEN p.ts - INTERVAL 1 HOUR AND p.ts + INTERVAL 1 HOUR AND e.event_id <> p.event_id
WHERE p.event_type = 'purchase' GROUP BY 1
""")
def q3(m):
    events = m.raw("events").select("event_id", "event_type", "user_id", F.unix_micros("ts").alias("at"))
    return counts_around(events, 3600 * 1_000_000, key="event_id", at="at", who="user_id", centre=F.col("event_type") == "purchase")


_K = "SELECT o_orderkey FROM orders WHERE o_custkey % {0} = 0"


@query("a2_maintained_per_day", f"""
SELECT strftime(created_at, '%Y-%m-%d') AS date, count(*) AS items, sum(coalesce(num_media, 0))::BIGINT AS total_generated,
  coalesce(sum(num_media) FILTER (WHERE mime_type LIKE 'image/%'), 0)::BIGINT AS images, coalesce(sum(num_media) FILTER (WHERE mime_type LIKE 'video/%'), 0)::BIGINT AS videos,
  coalesce(sum(num_media) FILTER (WHERE mime_type LIKE 'audio/%'), 0)::BIGINT AS audios
FROM media_items WHERE CASE WHEN id IN ({_K.format(7)}) THEN false WHEN id IN ({_K.format(10)}) THEN true WHEN id IN ({_K.format(5)}) THEN false ELSE deleted_at IS NULL END GROUP BY 1
""")
def a2(m):
    rows = m.media_items.select("id", "mime_type", "num_media", "created_at", "deleted_at", "deleted_by")
    media = KeyedTable.create(rows, shared_dir(m.spark, "media"), ["id"])
    report = summaries.DailyMedia.create(rows, shared_dir(m.spark, "report"))
    report.change(media, keys(m, 5), lambda: media.soft_delete(keys(m, 5), now(), by=42))
    report.change(media, keys(m, 10), lambda: media.restore(keys(m, 10)))
    report.change(media, keys(m, 7), lambda: media.hard_delete(keys(m, 7)))
    return report.read().withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query("a6_sketched_active_users", """
SELECT strftime(created_at, '%Y-%m') AS month, count(*) AS items, count(DISTINCT user_email) AS users, true AS users_near, true AS median_near
FROM media_items WHERE deleted_at IS NULL GROUP BY 1
""")
def a6(m):
    """Months from stored sketches of their days, beside the exact numbers: the estimates
    must lie within four standard errors, and the median's rank within its bound."""
    stored = cut_lineage(summaries.day_sketches(m.media_items), "sketches")
    month = F.date_format("date", "yyyy-MM").alias("month")
    merged = summaries.distinct_users(summaries.merged_sketches(stored, [month]), "estimate").withColumn("median", summaries.measure_quantile(0.5))
    live = m.media_items.filter("deleted_at IS NULL").select(F.date_format("created_at", "yyyy-MM").alias("month"), "user_email", F.col("generation_time").alias("g"))
    exact = live.join(merged.select("month", "median"), "month").groupBy("month").agg(
        F.countDistinct("user_email").alias("exact"), F.avg((F.col("g") < F.col("median")).cast("double")).alias("below"),
        F.avg((F.col("g") <= F.col("median")).cast("double")).alias("upto"), F.count("g").alias("n"),
    )
    slack = 2 * summaries.KLL_ERROR + 1 / F.col("n")
    return merged.join(exact, "month").select(
        "month", "items", F.col("exact").alias("users"),
        (F.abs(F.col("estimate") - F.col("exact")) <= 4 * summaries.HLL_ERROR * F.col("exact") + 1).alias("users_near"),
        ((F.col("below") <= 0.5 + slack) & (F.col("upto") >= 0.5 - slack)).alias("median_near"),
    )
