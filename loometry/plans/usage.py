"""Usage reports (A1-A6) and their filters and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from loometry.functions.media import count_of, day_range, not_deleted
from loometry.operators import reports
from loometry.plans.registry import query

START, END, TODAY = "1996-01-01", "1998-06-30", "1999-05-15"

IN_RANGE = f"deleted_at IS NULL AND created_at >= TIMESTAMP '{START}' AND created_at < TIMESTAMP '{END}' + INTERVAL 1 DAY"
SUMS = ", ".join(
    f"coalesce(sum(CASE WHEN mime_type LIKE '{c}/%' THEN len(gcs_uris) ELSE 0 END), 0)::BIGINT AS {n}"
    for n, c in (("images", "image"), ("videos", "video"), ("audios", "audio"))
)


@query("a1_overview", f"""
WITH t AS (SELECT {SUMS} FROM media_items WHERE {IN_RANGE}),
u AS (SELECT count(*) AS n FROM users WHERE deleted_at IS NULL AND created_at < TIMESTAMP '{END}' + INTERVAL 1 DAY),
w AS (SELECT count(*) AS n FROM workspaces WHERE created_at < TIMESTAMP '{END}' + INTERVAL 1 DAY),
s AS (SELECT count(*) AS n FROM source_assets WHERE {IN_RANGE})
SELECT u.n AS total_users, w.n AS total_workspaces, images AS images_generated, videos AS videos_generated,
  audios AS audios_generated, images + videos + audios AS total_media, s.n AS user_uploaded_media,
  images + videos + audios + s.n AS overall_total_media FROM t, u, w, s
""")
def a1(m):
    return reports.overview(m.users, m.workspaces, m.source_assets, m.media_items, START, END)


@query("a2_media_per_day", f"""
SELECT strftime(created_at, '%Y-%m-%d') AS date, sum(len(gcs_uris))::BIGINT AS total_generated, {SUMS}
FROM media_items WHERE deleted_at IS NULL GROUP BY 1
""")
def a2(m):
    out = reports.media_per_day(m.media_items)
    return out.withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query("a3_top_workspaces", f"""
SELECT workspace_id, w.name AS workspace_name, sum(len(gcs_uris))::BIGINT AS total_media, {SUMS}
FROM media_items i JOIN workspaces w ON w.id = i.workspace_id
WHERE i.deleted_at IS NULL AND i.created_at >= TIMESTAMP '{START}' AND i.created_at < TIMESTAMP '{END}' + INTERVAL 1 DAY
GROUP BY 1, 2 ORDER BY total_media DESC NULLS FIRST, workspace_id LIMIT 10
""")
def a3(m):
    return reports.media_per_workspace(m.media_items, m.workspaces, START, END)


@query("a4_active_roles", f"""
SELECT role, count(DISTINCT id) AS count FROM (
  SELECT id, unnest(roles) AS role FROM users
  WHERE deleted_at IS NULL AND email IN (SELECT user_email FROM media_items WHERE {IN_RANGE}))
GROUP BY role
""")
def a4(m):
    return reports.active_roles(m.users, m.media_items, START, END)


@query("a5_generation_health", "SELECT status, count(id) AS count FROM media_items WHERE deleted_at IS NULL GROUP BY 1")
def a5(m):
    return reports.generation_health(m.media_items)


@query("a6_monthly_active_users", f"""
SELECT strftime(s.m, '%Y-%m') AS month, coalesce(n, 0) AS count
FROM (SELECT unnest(generate_series(DATE '1996-01-01', DATE '{END}', INTERVAL 1 MONTH)) AS m) s
LEFT JOIN (SELECT strftime(created_at, '%Y-%m') AS mm, count(DISTINCT user_email) AS n
  FROM media_items WHERE {IN_RANGE} GROUP BY 1) c ON c.mm = strftime(s.m, '%Y-%m')
""")
def a6(m):
    return reports.monthly_active_users(m.media_items, START, END, today=TODAY)


@query("j14_calendar_spine", f"""
SELECT strftime(s.m, '%Y-%m') AS month, coalesce(n, 0) AS count
FROM (SELECT unnest(generate_series(date_trunc('month', DATE '{TODAY}' - INTERVAL 180 DAY), DATE '{TODAY}', INTERVAL 1 MONTH)) AS m) s
LEFT JOIN (SELECT strftime(created_at, '%Y-%m') AS mm, count(DISTINCT user_email) AS n
  FROM media_items WHERE deleted_at IS NULL AND created_at >= TIMESTAMP '{START}' GROUP BY 1) c ON c.mm = strftime(s.m, '%Y-%m')
""")
def j14(m):
    # Only one of the two days is given: the spine falls back to the last 180 days.
    return reports.monthly_active_users(m.media_items, START, None, today=TODAY)


@query("f1_not_deleted", "SELECT id, user_email, status FROM media_items WHERE deleted_at IS NULL")
def f1(m):
    return m.media_items.filter(not_deleted()).select("id", "user_email", "status")


@query("f2_day_range", f"SELECT id, strftime(created_at, '%Y-%m-%d') AS day FROM media_items WHERE created_at >= TIMESTAMP '{START}' AND created_at < TIMESTAMP '{END}' + INTERVAL 1 DAY")
def f2(m):
    return m.media_items.filter(day_range(F.col("created_at"), START, END)).select(
        "id", F.date_format("created_at", "yyyy-MM-dd").alias("day")
    )


@query("j5_active_users", f"""
SELECT id, email FROM users WHERE deleted_at IS NULL AND email IN (SELECT user_email FROM media_items WHERE {IN_RANGE})
""")
def j5(m):
    active = m.media_items.filter(not_deleted() & day_range(F.col("created_at"), START, END))
    active = active.select(F.col("user_email").alias("_email")).distinct()
    return m.users.filter(not_deleted()).join(active, F.col("email") == F.col("_email"), "left_semi").select("id", "email")


@query("j7_media_with_workspace", f"""
SELECT w.id AS workspace_id, w.name AS workspace_name, count(*) AS items, sum(len(gcs_uris))::BIGINT AS files
FROM media_items i JOIN workspaces w ON w.id = i.workspace_id WHERE i.deleted_at IS NULL GROUP BY 1, 2
""")
def j7(m):
    per_id = m.media_items.filter(not_deleted()).groupBy("workspace_id").agg(
        F.count(F.lit(1)).alias("items"), F.sum(count_of()).alias("files")
    )
    names = m.workspaces.select(F.col("id").alias("workspace_id"), F.col("name").alias("workspace_name"))
    return per_id.join(names, "workspace_id").select("workspace_id", "workspace_name", "items", "files")


@query("l3_top_by_aggregate", """
SELECT user_email, sum(len(gcs_uris))::BIGINT AS files FROM media_items WHERE deleted_at IS NULL
GROUP BY 1 ORDER BY files DESC NULLS FIRST, user_email LIMIT 10
""")
def l3(m):
    return (
        m.media_items.filter(not_deleted()).groupBy("user_email").agg(F.sum(count_of()).alias("files"))
        .orderBy(F.desc_nulls_first("files"), "user_email").limit(10)
    )
