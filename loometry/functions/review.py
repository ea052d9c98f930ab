"""Expressions for review links, runs and change detection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loometry import fixed
from loometry.functions.text import strip


def content_hash(field: Column, source: Column, translation: Column) -> Column:
    """Fingerprint of a segment and its translation."""
    parts = [F.coalesce(strip(c), F.lit("")) for c in (field, source, translation)]
    return F.sha2(F.concat_ws(fixed.HASH_SEPARATOR, *parts), 256)


def is_changed(stored: Column, current: Column) -> Column:
    """True when both fingerprints are set and differ."""
    both = (F.coalesce(stored, F.lit("")) != "") & (F.coalesce(current, F.lit("")) != "")
    return F.coalesce(both & (stored != current), F.lit(False))


def link_status(token_hash: Column, revoked_at: Column, expires_at: Column, now: Column) -> Column:
    return (
        F.when(F.coalesce(token_hash, F.lit("")) == "", "none")
        .when(revoked_at.isNotNull(), "revoked")
        .when(expires_at.isNull() | (expires_at <= now), "expired")
        .otherwise("active")
    )


def final_run_status(status: Column, state: Column) -> Column:
    """The status a running run takes from its executor; others keep theirs."""
    known = F.create_map(*[F.lit(x) for pair in fixed.RUN_STATUS.items() for x in pair])
    return F.when(status == "running", F.coalesce(known[state], status)).otherwise(status)


def duration_seconds(start: Column, end: Column, now: Column) -> Column:
    """Seconds from start to end, or to ``now`` while running; 0 without a start."""
    seconds = (
        F.unix_micros(F.coalesce(end, now).cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    ) / F.lit(1e6)
    return F.round(F.coalesce(seconds, F.lit(0.0)), 2)
