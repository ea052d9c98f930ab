from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loometry.operators import lineage as ln

OUT = "run_id long, entry_pos long, step_id string, output string, value string"
IN = "run_id long, entry_pos long, step_id string, input string, item_pos int, ref_step string, ref_output string, literal string"


def test_inputs_see_only_earlier_runs_of_a_step(spark):
    outputs = spark.createDataFrame([(1, 0, "in", "x", "7"), (1, 1, "a", "img", "old"), (1, 3, "a", "img", "new"), (1, 4, "a", "other", "o")], OUT)
    entries = outputs.select("run_id", "entry_pos", "step_id")
    inputs = spark.createDataFrame([
        (1, 2, "b", "p", 0, "a", "img", None),      # the first run of a
        (1, 4, "b", "p", 0, "a", "img", None),      # its second run
        (1, 4, "b", "p", 1, "in", "x", None),       # user input
        (1, 4, "b", "p", 2, None, None, "plain"),
        (1, 5, "b", "p", 0, "a", "img", None),      # the latest run of a has no img
        (1, 1, "b", "p", 0, "zzz", "img", None),    # no such step
        (1, 0, "b", "p", 0, "a", "img", None),      # a has not run yet
    ], IN)
    got = {(r["entry_pos"], r["item_pos"]): r["value"] for r in ln.resolve_inputs(inputs, outputs, entries).collect()}
    assert got == {(2, 0): "old", (4, 0): "new", (4, 1): "7", (4, 2): "plain", (5, 0): None, (1, 0): None, (0, 0): None}


def test_media_of_runs_follows_everything(spark):
    outputs = spark.createDataFrame([
        (1, 1, "a", "img", "[1, [2, {\"sourceAssetId\": 3}]]"),
        (1, 2, "b", "img", '{"step": "a", "output": "img"}'),
        (1, 3, "loop", "o", '{"step": "loop", "output": "o"}'),
        (1, 4, "a2", "img", "8"), (1, 5, "a2", "img", "9"),
    ], OUT)
    values = spark.createDataFrame([
        (1, '{"step": "b", "output": "img"}'), (1, '{"step": "loop", "output": "o"}'), (1, '{"step": "a2", "output": "img"}'),
        (1, '{"sourceMediaItem": {"mediaItemId": 5}}'), (1, '{"source_asset_id": 6}'), (1, '["7", "text"]'), (1, '"4"'),
        (1, "0"), (1, None), (1, "true"), (1, '{"step": "none", "output": "x"}'), (2, "1"), (2, "not json"),
    ], "run_id long, value string")
    values = values.withColumn("field_type", F.lit("video"))
    seeds = spark.createDataFrame([(2, "77", "number"), (2, "78", "text"), (2, "79", None)], "run_id long, value string, field_type string")
    got = {(r["run_id"], r["kind"], r["id"]) for r in ln.media_of_runs(values.unionByName(seeds), outputs).collect()}
    assert got == {
        (1, "media", "1"), (1, "media", "2"), (1, "asset", "3"), (1, "media", "9"), (1, "media", "5"), (1, "asset", "6"), (2, "media", "1"),
    }


ASSET = "id long, gcs_uri string, deleted_at timestamp"


def batch(spark, *args):
    rows = spark.createDataFrame([(i, a) for i, a in enumerate(args)], "row_index long, args map<string,string>")
    assets = spark.createDataFrame([(1, "gs://a", None), (2, "gs://b", None), (5, "gs://a", None), (3, "gs://gone", dt.datetime(2024, 1, 1))], ASSET)
    return [r.asDict() for r in ln.rewrite_batch_args(rows, assets).orderBy("row_index").collect()]


def test_batch_success(spark):
    got = batch(spark, {"workspace_id": "1", "image": "gs://a", "text": "hi"}, {"workspace_id": "1", "refs": '["gs://b","gs://a"]'}, {"text": "no uris"})
    assert [r["status"] for r in got] == ["SUCCESS"] * 3
    assert got[0]["args"] == {"workspace_id": "1", "text": "hi", "image": '{"sourceAssetId":1,"previewUrl":"gs://a"}'}
    assert got[1]["args"]["refs"] == '[{"sourceAssetId":2,"previewUrl":"gs://b"},{"sourceAssetId":1,"previewUrl":"gs://a"}]'
    assert got[2]["args"] == {"text": "no uris"}


def test_batch_failure(spark):
    got = batch(spark, {"image": "gs://a"}, {"workspace_id": "", "image": "gs://a"}, {"workspace_id": "1", "image": "gs://gone"}, {"workspace_id": "1", "image": "gs://b"})
    assert [r["status"] for r in got] == ["FAILED", "FAILED", "FAILED", "SUCCESS"]
    assert got[0]["error"] == "Invalid GCS URI in 'image': No workspace_id provided for GCS ingestion."
    assert "not found" in got[2]["error"] and got[0]["args"] is None


def test_headers():
    assert ln.map_headers([" Aspect  Ratio", "Prompt", "junk", "RAW"], ["aspect_ratio", "prompt", "RAW"]) == {
        " Aspect  Ratio": "aspect_ratio", "Prompt": "prompt", "RAW": "RAW",
    }
    with pytest.raises(ValueError, match="Missing required columns: style"):
        ln.map_headers(["prompt"], ["prompt", "style"])


def test_status_and_duration(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(1, "running", "SUCCEEDED", start, start + dt.timedelta(seconds=90.5)), (2, "running", "ACTIVE", start, None),
            (3, "completed", "FAILED", start, None), (4, "running", "CANCELLED", start, None), (5, "running", "FAILED", None, None)]
    runs = spark.createDataFrame(rows, "id long, status string, state string, started_at timestamp, ended_at timestamp")
    now = F.lit(start + dt.timedelta(seconds=200)).cast("timestamp")
    synced = {r["id"]: (r["status"], r["completed_at"]) for r in ln.sync_run_status(runs, now).collect()}
    assert synced[1] == ("completed", start + dt.timedelta(seconds=90.5))
    assert synced[2] == ("running", None) and synced[3] == ("completed", None)
    assert synced[4] == ("canceled", start + dt.timedelta(seconds=200)) and synced[5][0] == "failed"
    took = {r["id"]: r["duration"] for r in ln.run_durations(runs, now).collect()}
    assert took == {1: 90.5, 2: 200.0, 3: 200.0, 4: 200.0, 5: 0.0}


def test_links(spark):
    items = spark.createDataFrame(
        [(1, [(7, "input"), (8, "input"), (7, "mask")], [(10, 0, "edit"), (10, 2, "edit"), (10, -1, "edit"), (11, 0, "edit")]), (2, None, None)],
        "id long, source_assets array<struct<asset_id:long,role:string>>, source_media_items array<struct<media_item_id:long,media_index:int,role:string>>",
    )
    assets = spark.createDataFrame(
        [(7, "gs://7", "image/png", None, None), (8, "gs://8", "image/png", None, dt.datetime(2024, 1, 1))],
        "id long, gcs_uri string, mime_type string, thumbnail_gcs_uri string, deleted_at timestamp",
    )
    got = {r["id"]: [(x["asset_id"], x["role"]) for x in r["source_assets"]] for r in ln.enrich_asset_links(items, assets).collect()}
    assert got == {1: [(7, "input"), (7, "mask")], 2: []}
    parents = spark.createDataFrame(
        [(10, ["u0", "u1"], ["t0"], "image/png", None), (11, None, None, "image/png", None)],
        "id long, gcs_uris array<string>, thumbnail_uris array<string>, mime_type string, deleted_at timestamp",
    )
    rows = ln.parent_links(items, parents).collect()
    assert [(r["id"], r["parent_id"], r["gcs_uri"], r["thumbnail_uri"]) for r in rows] == [(1, 10, "u0", "t0")]


def test_step_entries_are_aggregated_once(model):
    """Inputs and outputs read the stored entries instead of the lines again."""
    for table in (model.step_inputs, model.step_outputs, model.step_entries):
        assert "Aggregate" not in table._jdf.queryExecution().optimizedPlan().toString()
