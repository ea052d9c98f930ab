"""Reports that do not read everything again: mergeable sketches of days, and totals of
days that changes adjust.

A sketch is a small stored value that sums up a day: its distinct users (HyperLogLog) and
the distribution of a measure (KLL). Sketches of any days merge to the sketch of their
union, so a range is answered from as many rows as it has days. Daily totals follow a
change by what its rows counted before and after it; only their days are written.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loometry.functions.media import MEDIA_CLASSES, not_deleted
from loometry.sources.keyed import KeyedTable

#: log2 of the registers of a distinct-count sketch; its standard error is
#: 1.04 / sqrt(registers), 1.6 % here.
HLL_BITS = 12
HLL_ERROR = 1.04 / 2 ** (HLL_BITS / 2)
#: Size parameter of a distribution sketch; ranks are off by at most 1.65 % (at 99 %).
KLL_SIZE = 200
KLL_ERROR = 0.0165


def day_sketches(media_items: DataFrame, user: str = "user_email", measure: str = "generation_time") -> DataFrame:
    """Per day: the number of items, and sketches of their users and of the measure.
    Deleted items do not count; null users and measures leave no trace."""
    return (
        media_items.filter(not_deleted() & F.col("created_at").isNotNull())
        .groupBy(F.to_date("created_at").alias("date"))
        .agg(
            F.count(F.lit(1)).alias("items"), F.hll_sketch_agg(F.col(user), F.lit(HLL_BITS)).alias("users"),
            F.kll_sketch_agg_double(F.col(measure).cast("double"), F.lit(KLL_SIZE)).alias("measure"),
        )
    )


def merged_sketches(sketches: DataFrame, by: Sequence[Column] = ()) -> DataFrame:
    """Sketches of groups of days, merged."""
    return sketches.groupBy(*by).agg(
        F.sum("items").alias("items"), F.hll_union_agg("users").alias("users"), F.kll_merge_agg_double("measure").alias("measure")
    )


def distinct_users(merged: DataFrame, name: str = "users") -> DataFrame:
    """The estimate in place of the sketch."""
    return merged.withColumn(name, F.hll_sketch_estimate("users"))


def measure_quantile(share: float) -> Column:
    return F.kll_sketch_get_quantile_double("measure", F.lit(share))


# ---------------------------------------------------------------- totals of days

_TOTALS = ("items", "total_generated", *MEDIA_CLASSES)


def day_totals(media_items: DataFrame) -> DataFrame:
    """Per day: items that are not deleted, their files (``num_media``), and files by class."""
    files = F.coalesce(F.col("num_media").cast("long"), F.lit(0).cast("long"))
    return (
        media_items.filter(not_deleted() & F.col("created_at").isNotNull())
        .groupBy(F.to_date("created_at").alias("date"))
        .agg(
            F.count(F.lit(1)).alias("items"), F.sum(files).alias("total_generated"),
            *[F.coalesce(F.sum(F.when(F.col("mime_type").startswith(prefix), files)), F.lit(0).cast("long")).alias(name) for name, prefix in MEDIA_CLASSES.items()],
        )
    )


class DailyMedia:
    """Daily totals, stored by date, that follow the changes of a media table."""

    def __init__(self, table: KeyedTable):
        self.table = table

    @classmethod
    def create(cls, media_items: DataFrame, path: str) -> DailyMedia:
        return cls(KeyedTable.create(day_totals(media_items), path, ["date"]))

    def follow(self, before: DataFrame, after: DataFrame) -> int:
        """Adjust the totals by rows as they were and as they are after a change (rows
        that are new have no before, rows that went no after). Days whose totals stay as
        they were are not written. Returns the version written."""
        minus = day_totals(before).select("date", *[(-F.col(c)).alias(c) for c in _TOTALS])
        moved = minus.unionByName(day_totals(after)).groupBy("date").agg(*[F.sum(c).alias(c) for c in _TOTALS])
        moved = moved.filter(" OR ".join(f"{c} <> 0" for c in _TOTALS))
        old = self.table.rows(moved)
        now = old.unionByName(moved).groupBy("date").agg(*[F.sum(c).alias(c) for c in _TOTALS])
        return self.table.write(now, deleted=F.col("items") == 0)

    def read(self) -> DataFrame:
        return self.table.read()

    def change(self, media: KeyedTable, keys: DataFrame, act) -> None:
        """Run ``act`` on the media table and follow what it does to the rows of ``keys``."""
        before = media.rows(keys, upto=media.version())
        act()
        self.follow(before, media.rows(keys))
