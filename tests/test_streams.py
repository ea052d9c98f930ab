from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from loometry.operators import reports
from loometry.streaming import streams as st

T0 = dt.datetime(2024, 1, 1)


def feed(spark, folder, schema, batches):
    """One file per batch, read one file at a time."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/b={i:03d}")
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", True).parquet(str(folder))
    )


def hour(n):
    return T0 + dt.timedelta(hours=n)


def test_media_per_day_equals_batch(spark, tmp_path):
    schema = "created_at timestamp, mime_type string, gcs_uris array<string>, deleted_at timestamp"
    batches = [
        [(hour(1), "image/png", ["a", "b"], None), (hour(30), "video/mp4", ["c"], None), (hour(2), "image/png", ["x"], hour(3))],
        [(hour(5), "audio/wav", ["d"], None)],
        [(hour(200), "image/png", ["e"], None)],
        [(hour(201), "image/png", ["e"], None)],
        # Days long past the watermark: late, and dropped one batch later.
        [(hour(6), "image/png", ["late"], None)],
    ]
    media = feed(spark, tmp_path / "in", schema, batches)
    got = st.run_to_table(st.media_per_day(media, "1 day"), str(tmp_path / "out"))
    kept = [r for b in batches[:4] for r in b]
    want = reports.media_per_day(spark.createDataFrame(kept, schema)).filter("date < '2024-01-08'")
    columns = ["date", "total_generated", "images", "videos", "audios"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


def test_stuck_jobs(spark, tmp_path):
    schema = "job_id long, ts timestamp, status string"
    minute = lambda n: T0 + dt.timedelta(minutes=n)
    batches = [
        [(1, minute(0), "processing"), (2, minute(0), "processing"), (3, minute(0), "processing")],
        [(1, minute(30), "completed"), (3, minute(50), "processing")],
        [(3, minute(100), "completed"), (2, minute(90), "completed")],
        [(9, minute(600), "completed")],
        [(9, minute(601), "completed")],
    ]
    got = st.run_to_table(st.stuck_jobs(feed(spark, tmp_path / "in", schema, batches), "5 minutes"), str(tmp_path / "out"))
    # Job 2 completed only after its hour was over.
    assert [(r["job_id"], r["last_seen"]) for r in got.collect()] == [(2, minute(0))]


def test_active_users(spark, tmp_path):
    schema = "user string, ts timestamp"
    batches = [[("a", hour(1)), ("a", hour(2)), ("b", hour(3))], [("a", hour(23)), ("a", hour(25))], [("c", hour(100))], [("c", hour(101))]]
    got = st.run_to_table(st.active_users_per_day(feed(spark, tmp_path / "in", schema, batches)), str(tmp_path / "out"))
    assert sorted((str(r["date"]), r["users"]) for r in got.collect()) == [("2024-01-01", 2), ("2024-01-02", 1)]


def test_first_uploads(spark, tmp_path):
    schema = "id long, user_id long, file_hash string, created_at timestamp"
    batches = [[(1, 1, "h", hour(0))], [(2, 1, "h", hour(1)), (3, 2, "h", hour(1))], [(4, 1, "g", hour(2))]]
    got = st.run_to_table(st.first_uploads(feed(spark, tmp_path / "in", schema, batches), "7 days"), str(tmp_path / "out"))
    assert sorted(r["id"] for r in got.collect()) == [1, 3, 4]


def test_latest_progress(spark, tmp_path):
    schema = "report_id long, ts timestamp, event_id long, kind string, text string"
    batches = [[(1, hour(1), 1, "text", "x" * 500), (2, hour(1), 2, "tool", "y" * 500)], [(1, hour(3), 3, "text", "new")], [(1, hour(2), 4, "text", "older")]]
    events = st.progress_steps(feed(spark, tmp_path / "in", schema, batches))
    got = {r["report_id"]: r["text"] for r in st.run_merge(events, str(tmp_path / "out"), ["report_id"], ["ts", "event_id"]).collect()}
    assert got == {1: "new", 2: "y" * 500}


def test_repeated_batch_changes_nothing(spark, tmp_path):
    write = st.merge_latest(str(tmp_path / "t"), ["k"], ["n"])
    one = spark.createDataFrame([("a", 1), ("b", 1)], "k string, n int")
    two = spark.createDataFrame([("a", 2)], "k string, n int")
    write(one, 0)
    write(two, 1)
    write(two, 1)
    got = st.read_latest(spark, str(tmp_path / "t"), one)
    assert {r["k"]: r["n"] for r in got.collect()} == {"a": 2, "b": 1}


def test_progress_text_is_cut(spark):
    df = spark.createDataFrame([("tool", "z" * 300), ("text", "z" * 300)], "kind string, text string")
    assert [len(r["text"]) for r in st.progress_steps(df).collect()] == [300, 200]
    assert st.progress_steps(df).filter(F.length("text") > 300).count() == 0
