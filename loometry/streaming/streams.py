"""Event-time operators over streams.

State is keyed and bounded by the watermark; nothing is kept in Python. Results
go to files or to versioned tables, never through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loometry import fixed
from loometry.functions.media import MEDIA_CLASSES, class_sums, count_of
from loometry.functions.text import progress_text
from loometry.operators.scans import one_row
from loometry.sources.tables import read_table


def media_per_day(media: DataFrame, delay: str) -> DataFrame:
    """Files per day and class; a day is final once the watermark has passed it."""
    return (
        media.filter(F.col("deleted_at").isNull())
        .withWatermark("created_at", delay)
        .groupBy(F.window("created_at", "1 day"))
        .agg(F.sum(count_of()).alias("total_generated"), *class_sums())
        .select(F.to_date("window.start").alias("date"), "total_generated", "images", "videos", "audios")
    )


def files_per_day(items: DataFrame, files: DataFrame, delay: str, within: str) -> DataFrame:
    """Files per day of their item and class, from a stream of items (id, mime_type,
    created_at, deleted_at) and one of their files (item_id, made_at).

    A file belongs to an item if it was made no earlier, and at most ``within`` later;
    so both sides wait for each other for a bounded time. A day is final once the
    watermarks (the smaller of the two, less ``within``) have passed it; files and items
    older than the watermark are dropped. Files of deleted items do not count.
    """
    left = items.filter(F.col("deleted_at").isNull()).select("id", "mime_type", "created_at").withWatermark("created_at", delay)
    right = files.select("item_id", "made_at").withWatermark("made_at", delay)
    pairs = left.join(right, F.expr(f"id = item_id AND made_at >= created_at AND made_at <= created_at + INTERVAL {within}"))
    one = lambda prefix: F.count_if(F.col("mime_type").startswith(prefix))
    return (
        pairs.groupBy(F.window("created_at", "1 day"))
        .agg(F.count(F.lit(1)).alias("total_generated"), *[one(prefix).alias(name) for name, prefix in MEDIA_CLASSES.items()])
        .select(F.to_date("window.start").alias("date"), "total_generated", *MEDIA_CLASSES)
    )


def stuck_jobs(statuses: DataFrame, delay: str) -> DataFrame:
    """Jobs (job_id, ts, status) that were processing and heard nothing for an
    hour. A session closes after an hour of silence; the job is stuck when its
    last word was ``processing``."""
    return (
        statuses.withWatermark("ts", delay)
        .groupBy(F.session_window("ts", fixed.STUCK_AFTER), "job_id")
        .agg(F.max_by("status", "ts").alias("status"), F.max("ts").alias("last_seen"))
        .filter(F.col("status") == "processing")
        .select("job_id", "last_seen", F.col("session_window.end").alias("stuck_at"))
    )


def active_users_per_day(activity: DataFrame, delay: str = "1 day") -> DataFrame:
    """Distinct users (user, ts) per day. ``delay`` of a day or more keeps a
    user's first row of the day in state until the day is over, so the count is
    exact; rows later than the watermark are dropped."""
    daily = activity.withWatermark("ts", delay).withColumn("day", F.to_date("ts"))
    return (
        daily.dropDuplicatesWithinWatermark(["user", "day"])
        .groupBy(F.window("ts", "1 day"))
        .agg(F.count(F.lit(1)).alias("users"))
        .select(F.to_date("window.start").alias("date"), "users")
    )


def first_uploads(uploads: DataFrame, delay: str) -> DataFrame:
    """The first upload of each (user, content) that arrives; later copies are
    dropped while the first is within the watermark."""
    return uploads.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["user_id", "file_hash"])


def progress_steps(events: DataFrame) -> DataFrame:
    """Progress events as stored steps: tool messages whole, others cut."""
    return events.withColumn("text", progress_text(F.col("kind"), F.col("text")))


def merge_latest(path: str, keys: Sequence[str], order: Sequence[str]):
    """A ``foreachBatch`` function that keeps the latest row per key in a
    versioned table. Batch n reads version n and writes version n + 1, so a
    batch that is repeated after a failure gives the same table."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = one_row(batch, keys, [F.col(c) for c in order], latest=True)
        if batch_id > 0:
            stored = spark.read.schema(batch.schema).parquet(f"{path}/v={batch_id}")
            fresh = one_row(stored.unionByName(fresh), keys, [F.col(c) for c in order], latest=True)
        fresh.write.mode("overwrite").parquet(f"{path}/v={batch_id + 1}")

    return write


def run_to_table(stream: DataFrame, path: str) -> DataFrame:
    """Process everything that is there, appending to Parquet files, and read
    the result."""
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", f"{path}/checkpoint").option("path", f"{path}/data")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/data")


def run_batches(stream: DataFrame, checkpoint: str, write) -> None:
    """Process everything that is there, one micro-batch after the other."""
    query = (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def run_merge(stream: DataFrame, path: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Process everything that is there through ``merge_latest``."""
    run_batches(stream, f"{path}/checkpoint", merge_latest(f"{path}/table", keys, order))
    return read_latest(stream.sparkSession, f"{path}/table", stream)


def read_latest(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    found = read_table(spark, path)
    return found if found is not None else spark.createDataFrame([], like.schema)
