"""Usage reports. All of them leave out soft-deleted rows and take the days
they cover as ``YYYY-MM-DD`` strings, each optional."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loometry import fixed
from loometry.functions.media import class_sums, count_of, day_range, not_deleted


def _media(media_items: DataFrame, start: str | None, end: str | None) -> DataFrame:
    return media_items.filter(not_deleted() & day_range(F.col("created_at"), start, end))


def overview(
    users: DataFrame, workspaces: DataFrame, source_assets: DataFrame, media_items: DataFrame,
    start: str | None = None, end: str | None = None,
) -> DataFrame:
    """One row of totals. Users and workspaces count up to the end day only."""
    created = F.col("created_at")
    n = F.count(F.lit(1))
    n_users = users.filter(not_deleted() & day_range(created, None, end)).agg(n).scalar()
    n_workspaces = workspaces.filter(day_range(created, None, end)).agg(n).scalar()
    n_uploads = source_assets.filter(not_deleted() & day_range(created, start, end)).agg(n).scalar()
    media = _media(media_items, start, end).agg(*class_sums())
    total = F.col("images") + F.col("videos") + F.col("audios")
    return media.select(
        n_users.alias("total_users"),
        n_workspaces.alias("total_workspaces"),
        F.col("images").alias("images_generated"),
        F.col("videos").alias("videos_generated"),
        F.col("audios").alias("audios_generated"),
        total.alias("total_media"),
        n_uploads.alias("user_uploaded_media"),
    ).withColumn("overall_total_media", F.col("total_media") + F.col("user_uploaded_media"))


def media_per_day(media_items: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Files per day over all mime types, and per class."""
    return (
        _media(media_items, start, end)
        .groupBy(F.to_date("created_at").alias("date"))
        .agg(F.sum(count_of()).alias("total_generated"), *class_sums())
    )


def media_per_workspace(
    media_items: DataFrame, workspaces: DataFrame, start: str | None = None, end: str | None = None,
    top: int = fixed.TOP_WORKSPACES,
) -> DataFrame:
    """The busiest workspaces. Items without a known workspace drop out."""
    # Aggregated before the join: one row per workspace meets the names, and a
    # workspace with a third of all media is combined on the map side.
    per_id = (
        _media(media_items, start, end)
        .groupBy("workspace_id")
        .agg(F.sum(count_of()).alias("total_media"), *class_sums())
    )
    named = per_id.join(
        workspaces.select(F.col("id").alias("_id"), F.col("name").alias("workspace_name")),
        F.col("workspace_id") == F.col("_id"),
    ).drop("_id")
    return named.orderBy(F.desc_nulls_first("total_media"), F.asc("workspace_id")).limit(top)


def active_roles(
    users: DataFrame, media_items: DataFrame, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Users with media in the range, counted per role."""
    active = _media(media_items, start, end).select(F.col("user_email").alias("_email")).distinct()
    found = users.filter(not_deleted()).join(active, F.col("email") == F.col("_email"), "left_semi")
    # Ids are unique, so one occurrence per user and role is a row-local matter.
    return (
        found.select(F.explode(F.array_distinct("roles")).alias("role"))
        .groupBy("role").agg(F.count(F.lit(1)).alias("count"))
    )


def generation_health(media_items: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    return _media(media_items, start, end).groupBy("status").agg(F.count("id").alias("count"))


def month_spine(spark, start: str | None, end: str | None, today: str) -> DataFrame:
    """Months of the range when both days are given, else the last 180 days."""
    last = end if start and end else today
    first = start if start and end else str(
        datetime.date.fromisoformat(today) - datetime.timedelta(days=fixed.TRAILING_DAYS)
    )
    months = F.sequence(
        F.trunc(F.to_date(F.lit(first)), "month"), F.to_date(F.lit(last)), F.expr("interval 1 month")
    )
    return spark.range(1).select(F.explode(months).alias("m")).select(
        F.date_format("m", "yyyy-MM").alias("month")
    )


def monthly_active_users(
    media_items: DataFrame, start: str | None = None, end: str | None = None, *, today: str
) -> DataFrame:
    """Distinct users per month, months without users included."""
    counts = (
        _media(media_items, start, end)
        .groupBy(F.date_format("created_at", "yyyy-MM").alias("_month"))
        .agg(F.count_distinct("user_email").alias("n"))
    )
    spine = month_spine(media_items.sparkSession, start, end, today)
    return spine.join(counts, F.col("month") == F.col("_month"), "left").select(
        "month", F.coalesce("n", F.lit(0)).alias("count")
    )
