"""Ordered lookups: as-of joins and clip gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loometry import fixed
from loometry.operators.scans import chunked, scan


def asof_last(
    left: DataFrame, right: DataFrame, *, keys: Sequence[str], left_time: str, right_time: str,
    value: Column, name: str, strict: bool = False,
) -> DataFrame:
    """As-of join: add to each left row the ``value`` of the latest right row of
    its key at or before its time (before it, when ``strict``).

    Times are integers below 2^62. Both sides are put in one ordered stream and
    the value is carried forward, so the work is linear: no pairs are formed.
    Chunks along the time let a hot key run in many tasks. Right rows should be
    unique per key and time, and ``value`` never null (wrap it in a struct where
    it may be).
    """
    rest = [c for c in left.columns if c not in keys]
    # One integer orders the stream: the time, then the side that comes first.
    late = 0 if strict else 1
    a = left.select(
        *keys, (F.col(left_time).cast("long") * 2 + late).alias("_at"), F.struct(*rest).alias("_row"),
        F.lit(None).alias("_v"),
    )
    b = right.select(
        *keys, (F.col(right_time).cast("long") * 2 + 1 - late).alias("_at"), F.lit(None).alias("_row"),
        value.alias("_v"),
    )
    both, chunk = chunked(a.unionByName(b), keys, ["_at"])
    out = scan(both, keys, ["_at"], chunk, last={name: F.col("_v")})
    return out.filter(F.col("_row").isNotNull()).select(*keys, *[F.col("_row")[c].alias(c) for c in rest], name)


def clip_gaps(
    clips: DataFrame, track: str = "track_index", order: Sequence[str] = ("start_us", "clip_id"),
) -> DataFrame:
    """Silence before a clip: its start minus the end of the clip before it on
    the track (not the furthest end so far); the first clip compares with 0."""
    end = F.col("start_time") + F.col("duration")
    placed, chunk = chunked(clips, [track], list(order))
    linked = scan(placed, [track], list(order), chunk, before={"_end": end}).drop("_bucket")
    gap = F.col("start_time") - F.coalesce("_end", F.lit(0.0))
    return linked.withColumn("gap", gap).filter(F.col("gap") > fixed.CLIP_GAP_TOLERANCE).drop("_end")
