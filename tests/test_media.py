from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loometry.functions import media as md
from loometry.operators import gallery as g
from loometry.operators import reports
from loometry.operators.paging import deep_page_rows, page, page_rows


def test_month_spine(spark):
    months = lambda *a, **k: [r[0] for r in reports.month_spine(spark, *a, **k).orderBy("month").collect()]
    assert months("2023-11-20", "2024-02-01", "2030-01-01") == ["2023-11", "2023-12", "2024-01", "2024-02"]
    assert months(None, None, "2024-07-15") == ["2024-01", "2024-02", "2024-03", "2024-04", "2024-05", "2024-06", "2024-07"]
    assert months("2020-01-01", None, "2024-07-15")[0] == "2024-01"


def test_ratio(spark):
    cases = [(1920, 1080, "16:9"), (1080, 1920, "9:16"), (100, 100, "1:1"), (1000, 999, "1:1"), (500, 300, "other"), (10, 0, None),
             (80, 10, "8:1"), (2100, 900, "21:9")]
    df = spark.createDataFrame(cases, "w int, h int, want string")
    for r in df.withColumn("got", md.nearest_ratio(F.col("w"), F.col("h"))).collect():
        assert r["got"] == r["want"], r


def test_time_buckets(spark):
    as_of = "2024-03-06 10:00:00"  # a Wednesday
    cases = {
        "2024-03-06 00:00:01": "Today", "2024-03-05 23:59:59": "Yesterday", "2024-03-04 12:00:00": "Mar 3 - 9",
        "2024-03-01 12:00:00": "Feb 25 - Mar 2", "2024-01-06 12:00:00": "Dec 31 - Jan 6", "2024-01-05 12:00:00": "January 2024",
        "2024-03-08 12:00:00": "Mar 3 - 9",
    }
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "t string, want string")
    for r in df.withColumn("got", md.time_bucket(F.col("t").cast("timestamp"), F.lit(as_of).cast("timestamp"))).collect():
        assert r["got"] == r["want"], r


def test_asset_type_from_filename(spark):
    cases = {"vto_top_0.png": "vto_top", "vto_person_male_12.png": "vto_person_male", "vto_top.png": None, "x.png": None, "vto_top_a_1.png": None,
             "generic_image_3": "generic_image"}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "f string, want string")
    for r in df.withColumn("got", md.asset_type_from_filename(F.col("f"))).collect():
        assert r["got"] == r["want"], r


MEDIA = "id long, workspace_id long, user_id long, user_email string, mime_type string, model string, prompt string, status string, gcs_uris array<string>, thumbnail_uris array<string>, created_at timestamp, deleted_at timestamp"
ASSET = "id long, workspace_id long, user_id long, gcs_uri string, original_filename string, mime_type string, aspect_ratio string, scope string, asset_type string, thumbnail_gcs_uri string, created_at timestamp, deleted_at timestamp"
T = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def tables(spark):
    items = spark.createDataFrame([
        (1, 1, 1, "a@x", "image/png", "m1", "A 50% deal", "completed", ["gs://b/1"], ["gs://t/1"], T, None),
        (2, 1, 2, "b@x", "video/mp4", "m2", None, "failed", None, None, T, None),
        (3, None, 1, "a@x", "image/jpeg", "m1", "gone", "completed", ["u", "v"], [], T, T),
        (4, 2, 1, "a@x", "application/pdf", "m1", "plan_b", "completed", ["u", "v"], [], T + dt.timedelta(days=1), None),
    ], MEDIA)
    assets = spark.createDataFrame([
        (1, 1, 1, "gs://a/1.jpg", "deal.jpg", "image/jpeg", "1:1", "private", "vto_top", None, T, None),
        (2, 1, 2, "gs://a/2", "other", "audio/wav", "1:1", "system", "vto_shoe", "gs://t/2", T, None),
    ], ASSET)
    return items, assets


def test_unified(tables):
    rows = {(r["item_type"], r["id"]): r for r in g.unified_base(*tables).collect()}
    assert len(rows) == 6
    a1, a2 = rows["source_asset", 1], rows["source_asset", 2]
    assert (a1["status"], a1["gcs_uris"], a1["thumbnail_uris"]) == ("completed", ["gs://a/1.jpg"], [])
    assert a2["thumbnail_uris"] == ["gs://t/2"] and a2["is_audio"] and not a2["is_video"]
    assert rows["media_item", 2]["is_video"] and a1["prompt"] is None


@pytest.mark.parametrize("search, want", [
    (g.Search(), {("m", 1), ("m", 2), ("m", 4), ("s", 1), ("s", 2)}),
    (g.Search(include_deleted=True, mime_type="image/*"), {("m", 1), ("m", 3), ("s", 1)}),
    (g.Search(query="DEAL"), {("m", 1), ("s", 1)}),
    (g.Search(query="50% d"), {("m", 1)}),
    (g.Search(query="plan_"), {("m", 4)}),
    (g.Search(query="%"), {("m", 1), ("m", 2), ("m", 4), ("s", 1), ("s", 2)}),
    (g.Search(item_type="source_asset"), {("s", 1), ("s", 2)}),
    (g.Search(start=T + dt.timedelta(hours=1)), {("m", 4)}),
    (g.Search(end=T), {("m", 1), ("m", 2), ("s", 1), ("s", 2)}),
    (g.Search(workspace_id=1).for_role(is_admin=False), {("m", 1), ("s", 1), ("s", 2)}),
])
def test_filters(tables, search, want):
    got = {(r["item_type"][0], r["id"]) for r in g.filter_gallery(g.unified_base(*tables), search).collect()}
    assert got == want


def test_non_admin_needs_workspace():
    with pytest.raises(ValueError, match="workspace_id is required"):
        g.Search().for_role(is_admin=False)


def test_paging(spark):
    found = page(spark.range(25), [F.col("id").desc()], limit=10, offset=20)
    assert (found.count, found.page, found.page_size, found.total_pages) == (25, 3, 10, 3)
    assert [r["id"] for r in found.data.collect()] == [4, 3, 2, 1, 0]


def test_a_larger_page_is_refused(spark):
    for limit in (0, 101, 500):
        with pytest.raises(ValueError, match="1 to 100"):
            page_rows(spark.range(5), [F.col("id")], limit)


@pytest.mark.parametrize("offset", [0, 7, 480, 995, 1500, 2995, 3500])
def test_deep_page_equals_page(spark, offset):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, F.hash("id") % 50).alias("v"))
    order = [F.col("v").desc_nulls_first(), F.col("id").desc()]
    got = deep_page_rows(df, F.col("v"), order, 10, offset, deep=20, chunks=16)
    assert got.collect() == page_rows(df, order, 10, offset).collect()


def test_reports_null_arrays_and_roles(spark, tables):
    items, assets = tables
    users = spark.createDataFrame([
        (1, "a@x", ["user", "admin", "user"], T, None), (2, "b@x", [], T, None), (3, "c@x", ["user"], T, None), (4, "a@x", ["ghost"], T, T),
    ], "id long, email string, roles array<string>, created_at timestamp, deleted_at timestamp")
    spaces = spark.createDataFrame([(1, "one", T)], "id long, name string, created_at timestamp")
    row = reports.overview(users, spaces, assets, items).first()
    assert (row["total_users"], row["images_generated"], row["videos_generated"], row["total_media"], row["overall_total_media"]) == (3, 1, 0, 1, 3)
    late = reports.overview(users, spaces, assets, items, "2025-01-01", None).first()
    assert late["total_users"] == 3 and late["total_media"] == 0  # users ignore the start day
    days = {str(r["date"]): (r["total_generated"], r["images"]) for r in reports.media_per_day(items).collect()}
    assert days == {"2024-01-01": (1, 1), "2024-01-02": (2, 0)}  # other types count in the total only
    roles = {r["role"]: r["count"] for r in reports.active_roles(users, items).collect()}
    assert roles == {"user": 1, "admin": 1}
    top = reports.media_per_workspace(items, spaces).collect()
    assert [(r["workspace_id"], r["total_media"]) for r in top] == [(1, 1)]


def test_all_null_workspace_comes_first(spark, tables):
    items, _ = tables
    spaces = spark.createDataFrame([(1, "one", T), (2, "two", T)], "id long, name string, created_at timestamp")
    only_null = items.withColumn("gcs_uris", F.when(F.col("workspace_id") == 2, F.col("gcs_uris")))
    top = reports.media_per_workspace(only_null, spaces).collect()
    assert [r["workspace_id"] for r in top] == [1, 2]


def test_manifest(tables):
    names = {(r["item_type"][0], r["id"]): r["filename"] for r in g.download_manifest(g.unified_base(*tables)).collect()}
    assert names == {("m", 1): "media_1.png", ("m", 4): "media_4.pdf", ("s", 1): "asset_1.jpg", ("s", 2): "asset_2.bin"}


def test_empty_key_list(tables):
    assert g.by_keys(tables[0], "id", []).count() == 0
    assert g.by_keys(tables[0], "id", [1, 4]).count() == 2


def test_search_page(spark, tables):
    items, assets = tables
    users = spark.createDataFrame([(1, "a@x", "pic", T), (2, "b@x", None, None)], "id long, email string, picture string, deleted_at timestamp")
    spaces = spark.createDataFrame([(1, "one")], "id long, name string")
    tags = spark.createDataFrame([(5, "red", "#f00", 1), (6, "blue", "#00f", 1)], "id long, name string, color string, workspace_id long")
    links = g.item_tags(
        spark.createDataFrame([(1, 6), (1, 5), (2, 5)], "media_item_id long, tag_id long"),
        spark.createDataFrame([(1, 5)], "source_asset_id long, tag_id long"),
    )
    base = g.unified_base(items, assets)
    found = g.search_page(base, g.Search(tags=["red"], limit=2), links, tags, spaces, users)
    assert (found.count, found.total_pages) == (3, 2)
    rows = {(r["item_type"][0], r["id"]): r for r in found.data.collect()}
    assert set(rows) == {("m", 2), ("m", 1)}
    assert [t["name"] for t in rows["m", 1]["tags"]] == ["red", "blue"]
    assert rows["m", 1]["user_email"] == "a@x" and rows["m", 1]["workspace_name"] == "one"
    both = g.search_page(base, g.Search(tags=["red", "blue", "red"]), links, tags, spaces, users)
    assert [(r["item_type"], r["id"]) for r in both.data.collect()] == [("media_item", 1)]
    mine = g.search_page(base, g.Search(user_email="b@x", include_deleted=True), links, tags, spaces, users)
    assert mine.count == 2 and g.search_page(base, g.Search(status="stopped"), links, tags, spaces, users).count == 0
