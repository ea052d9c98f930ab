"""Expressions over media rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loometry import fixed

MEDIA_CLASSES = {"images": "image/", "videos": "video/", "audios": "audio/"}


def not_deleted(include_deleted: bool = False) -> Column:
    return F.lit(True) if include_deleted else F.col("deleted_at").isNull()


def mime_matches(mime: Column, wanted: str) -> Column:
    """Equality, or a prefix pattern when ``wanted`` holds ``*``."""
    return mime.like(wanted.replace("*", "%")) if "*" in wanted else mime == wanted


def day_range(ts: Column, start: str | None, end: str | None) -> Column:
    """Whole days, both ends included, each end optional (``YYYY-MM-DD``)."""
    cond = F.lit(True)
    if start:
        cond = cond & (ts >= F.to_timestamp(F.lit(start)))
    if end:
        cond = cond & (ts < F.to_timestamp(F.date_add(F.to_date(F.lit(end)), 1)))
    return cond


def moment_range(ts: Column, start=None, end=None) -> Column:
    """From ``start`` to 24 hours after ``end``; the end is not cut to its day."""
    cond = F.lit(True)
    if start is not None:
        cond = cond & (ts >= F.lit(start).cast("timestamp"))
    if end is not None:
        cond = cond & (ts < F.lit(end).cast("timestamp") + F.expr("interval 1 day"))
    return cond


def count_of(class_prefix: str | None = None) -> Column:
    """Files of a media row, optionally only when its mime type is of one class."""
    files = F.array_size("gcs_uris").cast("long")
    if class_prefix is None:
        return files
    return F.when(F.col("mime_type").startswith(class_prefix), files).otherwise(F.lit(0))


def class_sums() -> list[Column]:
    return [
        F.coalesce(F.sum(count_of(prefix)), F.lit(0)).alias(name)
        for name, prefix in MEDIA_CLASSES.items()
    ]


def nearest_ratio(width: Column, height: Column) -> Column:
    """The closest supported aspect ratio; ``other`` when none is near, null
    where the height is zero."""
    actual = width.cast("double") / F.nullif(height, F.lit(0)).cast("double")
    options = F.array(*[
        F.struct(
            F.abs(F.lit(int(r.split(":")[0]) / int(r.split(":")[1])) - actual).alias("diff"),
            F.lit(order).alias("ord"),
            F.lit(r).alias("ratio"),
        )
        for order, r in enumerate(fixed.ASPECT_RATIOS)
    ])
    best = F.array_min(options)
    return F.when(actual.isNull(), F.lit(None).cast("string")).otherwise(
        F.when(best["diff"] > fixed.RATIO_TOLERANCE, F.lit(fixed.OTHER_RATIO)).otherwise(best["ratio"])
    )


def extension_from_uri(uri: Column) -> Column:
    return F.when(F.contains(uri, F.lit(".")), F.substring_index(uri, ".", -1)).otherwise(F.lit("bin"))


def extension_from_mime(mime: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in fixed.MIME_EXTENSIONS.items() for x in pair])
    return F.coalesce(known[mime], F.lit("bin"))


def asset_type_from_filename(filename: Column) -> Column:
    """``vto_top_0.png`` -> ``vto_top``; null when the name gives no known type."""
    base = F.regexp_replace(filename, r"(?<=[^.])\.[^.]*$", "")
    kind = F.regexp_replace(base, r"_?[^_]*$", "")
    return F.when(kind.isin(fixed.ASSET_TYPES), kind)


def time_bucket(ts: Column, as_of: Column) -> Column:
    """Gallery heading for a row: day names, then weeks from Sunday, then months."""
    day, today = F.to_date(ts), F.to_date(as_of)
    start = F.date_sub(day, F.dayofweek(day) - 1)
    end = F.date_add(start, 6)
    same_month = F.month(start) == F.month(end)
    week = F.concat(
        F.date_format(start, "MMM d"),
        F.lit(" - "),
        F.when(same_month, F.date_format(end, "d")).otherwise(F.date_format(end, "MMM d")),
    )
    return (
        F.when(day == today, "Today")
        .when(day == F.date_sub(today, 1), "Yesterday")
        .when(F.datediff(today, day) <= 60, week)
        .otherwise(F.date_format(day, "MMMM yyyy"))
    )
