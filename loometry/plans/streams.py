"""Streaming queries, run over the provided tables as file streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from loometry import fixed
from loometry.plans.bindings import MIME_BY_PRIORITY, _choose, assets_of
from loometry.plans.registry import query
from loometry.session import shared_dir
from loometry.streaming import streams as st


@query("st3_media_per_day", """
WITH pairs AS (SELECT o_orderdate::DATE AS d, left(o_orderpriority, 1) AS p FROM orders JOIN lineitem ON l_orderkey = o_orderkey
  AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 90 DAY WHERE o_orderkey % 17 <> 0),
mark AS (SELECT least((SELECT max(o_orderdate) FROM orders WHERE o_orderkey % 17 <> 0), (SELECT max(l_shipdate) FROM lineitem)) - INTERVAL 2 DAY - INTERVAL 90 DAY AS w)
SELECT strftime(d, '%Y-%m-%d') AS date, count(*) AS total_generated, count(*) FILTER (WHERE p IN ('1', '2')) AS images,
  count(*) FILTER (WHERE p = '3') AS videos, count(*) FILTER (WHERE p = '4') AS audios
FROM pairs, mark WHERE d + INTERVAL 1 DAY < w GROUP BY 1
""")
def st3(m):
    key, digit = F.col("o_orderkey"), F.substring("o_orderpriority", 1, 1)
    items = m.stream("orders").select(
        key.alias("id"), F.col("o_orderdate").alias("created_at"), _choose(digit, MIME_BY_PRIORITY, "application/pdf").alias("mime_type"),
        F.when(key % 17 == 0, F.col("o_orderdate")).alias("deleted_at"),
    )
    files = m.stream("lineitem").select(F.col("l_orderkey").alias("item_id"), F.col("l_shipdate").alias("made_at"))
    out = st.run_to_table(st.files_per_day(items, files, "2 days", "90 days"), shared_dir(m.spark, "st3"))
    return out.withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query("st2_stuck_jobs", """
WITH e AS (SELECT user_id AS job_id, ts, event_type = 'view' AS processing, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events),
s AS (SELECT *, sum((prev IS NULL OR ts >= prev + INTERVAL 1 HOUR)::INT) OVER (PARTITION BY job_id ORDER BY ts) AS session FROM e),
closed AS (SELECT job_id, session, max(ts) AS last_seen, arg_max(processing, ts) AS processing FROM s GROUP BY 1, 2)
SELECT job_id, strftime(last_seen, '%Y-%m-%d %H:%M:%S') AS last_seen FROM closed
WHERE processing AND last_seen + INTERVAL 1 HOUR <= date_trunc('milliseconds', (SELECT max(ts) FROM events)) - INTERVAL 10 MINUTE
""")
def st2(m):
    statuses = m.stream("events").select(
        F.col("user_id").alias("job_id"), "ts",
        F.when(F.col("event_type") == "view", "processing").otherwise(F.col("event_type")).alias("status"),
    )
    out = st.run_to_table(st.stuck_jobs(statuses, "10 minutes"), shared_dir(m.spark, "st2"))
    return out.select("job_id", F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss").alias("last_seen"))


@query("st4_active_users_per_day", """
SELECT strftime(ts, '%Y-%m-%d') AS date, count(DISTINCT user_id) AS users FROM events
WHERE ts::DATE + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY 1
""")
def st4(m):
    activity = m.stream("events").select(F.col("user_id").alias("user"), "ts")
    out = st.run_to_table(st.active_users_per_day(activity), shared_dir(m.spark, "st4"))
    return out.withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query("st5_first_uploads", "SELECT DISTINCT user_id, file_hash FROM source_assets")
def st5(m):
    uploads = assets_of(m.stream("part"))
    out = st.run_to_table(st.first_uploads(uploads, fixed.UPLOAD_RETENTION), shared_dir(m.spark, "st5"))
    return out.select("user_id", "file_hash")


PROGRESS = """SELECT user_id AS report_id, ts, event_id, event_type AS author, CASE WHEN event_id % 4 = 0 THEN 'tool' ELSE 'text' END AS kind, repeat(props || ' ', 40) AS text FROM events"""


def progress_stream(m):
    kind = F.when(F.col("event_id") % 4 == 0, "tool").otherwise("text")
    return st.progress_steps(m.stream("events").select(
        F.col("user_id").alias("report_id"), "ts", "event_id", F.col("event_type").alias("author"),
        kind.alias("kind"), F.repeat(F.concat("props", F.lit(" ")), F.lit(40)).alias("text"),
    ))


@query("st1_latest_progress", f"""
SELECT report_id, event_id, author, kind, CASE WHEN kind = 'tool' THEN text ELSE left(text, 200) END AS text FROM ({PROGRESS})
QUALIFY row_number() OVER (PARTITION BY report_id ORDER BY ts DESC, event_id DESC) = 1
""")
def st1(m):
    out = st.run_merge(progress_stream(m), shared_dir(m.spark, "st1"), ["report_id"], ["ts", "event_id"])
    return out.select("report_id", "event_id", "author", "kind", "text")


@query("st1_progress_steps", f"SELECT report_id, event_id, author, kind, CASE WHEN kind = 'tool' THEN text ELSE left(text, 200) END AS text FROM ({PROGRESS})")
def st1b(m):
    out = st.run_to_table(progress_stream(m), shared_dir(m.spark, "st1"))
    return out.select("report_id", "event_id", "author", "kind", "text")
