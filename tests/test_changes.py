from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from loometry import fixed
from loometry.operators import changes as ch

T0, T1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 6, 1)


def now():
    return F.lit(T1).cast("timestamp")



def keys(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id long")


def items(spark):
    return spark.createDataFrame(
        [(1, 1, "a", "processing", T0, T0, None, None), (2, 1, "b", "processing", T1, T0, None, None), (3, 2, "c", "completed", T0, T0, T0, 9)],
        "id long, workspace_id long, prompt string, status string, created_at timestamp, updated_at timestamp, deleted_at timestamp, deleted_by long",
    )


def test_soft_delete_and_restore(spark):
    gone = ch.soft_delete(items(spark), keys(spark, 1, 1, 3, 77), now(), by=5)
    assert {r["id"]: (r["deleted_at"], r["deleted_by"]) for r in gone.collect()} == {1: (T1, 5), 2: (None, None), 3: (T0, 9)}
    back = ch.restore(gone, keys(spark, 1, 3))
    assert all(r["deleted_at"] is None and r["deleted_by"] is None for r in back.collect())
    assert back.columns == items(spark).columns and back.count() == 3


def test_update_and_delete(spark):
    updates = spark.createDataFrame([(1, "new"), (2, None), (9, "x")], "id long, prompt string")
    got = {r["id"]: (r["prompt"], r["updated_at"]) for r in ch.partial_update(items(spark), updates, now()).collect()}
    assert got == {1: ("new", T1), 2: ("b", T1), 3: ("c", T0)}
    assert [r["id"] for r in ch.hard_delete(items(spark), keys(spark, 1, 3)).collect()] == [2]


def test_stuck(spark):
    got = {r["id"]: r["status"] for r in ch.stop_stuck_jobs(items(spark), now()).collect()}
    assert got == {1: "stopped", 2: "processing", 3: "completed"}


def test_insert_ignore_and_upsert(spark):
    table = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, v int, w string")
    rows = spark.createDataFrame([("a", 9, "n"), ("c", 5, "n"), ("c", 4, "n")], "k string, v int, w string")
    got = {r["k"]: r["v"] for r in ch.insert_ignore(table, rows, ["k"], [F.col("v")]).collect()}
    assert got == {"a": 1, "b": 2, "c": 4}
    up = ch.upsert(table, spark.createDataFrame([("a", None), ("d", 7)], "k string, v int"), ["k"])
    assert {r["k"]: (r["v"], r["w"]) for r in up.collect()} == {"a": (None, "x"), "b": (2, "y"), "d": (7, None)}
    swapped = ch.replace_by_key(table, rows.filter("k = 'c'"), ["k"])
    assert sorted(r["v"] for r in swapped.collect()) == [1, 2, 4, 5]


def tag_table(spark, n):
    return spark.createDataFrame(
        [(i, f"t{i}", "#FFFFFF", 1, 1, T0) for i in range(1, n + 1)],
        "id long, name string, color string, workspace_id long, user_id long, updated_at timestamp",
    )


def test_tag_colours_go_round(spark):
    tags = tag_table(spark, 18)
    wanted = spark.createDataFrame([(1, f"n{i}", i) for i in range(4)] + [(1, "t3", 9), (2, "x", 10), (1, "n0", 11)], "workspace_id long, name string, pos long")
    added = ch.create_tags(tags, wanted, 1, now()).orderBy("id").collect()
    assert [(r["id"], r["name"]) for r in added] == [(19, "n0"), (20, "n1"), (21, "n2"), (22, "n3"), (23, "x")]
    palette = fixed.TAG_COLORS
    assert [r["color"] for r in added] == [palette[18], palette[19], palette[0], palette[1], palette[0]]


def test_assign_replaces_tags(spark):
    tags = tag_table(spark, 3)
    links = spark.createDataFrame([(10, 1), (10, 2), (11, 1)], "media_item_id long, tag_id long")
    chosen = spark.createDataFrame([(10, 1), (12, 1), (10, 1)], "media_item_id long, workspace_id long")
    wanted = spark.createDataFrame([(1, "t3", 0), (1, "fresh", 1)], "workspace_id long, name string, pos long")
    next_tags, next_links = ch.assign_tags(tags, links, chosen, wanted, 7, now())
    assert sorted(tuple(r) for r in next_links.collect()) == [(10, 3), (10, 4), (11, 1), (12, 3), (12, 4)]
    assert {r["id"]: r["updated_at"] for r in next_tags.collect()} == {1: T0, 2: T0, 3: T1, 4: T1}


def test_copies(spark):
    got = ch.copies(items(spark), keys(spark, 2, 1, 3, 2), 100, 5, 8, now()).orderBy("id").collect()
    assert [(r["id"], r["workspace_id"], r["prompt"], r["created_at"], r["deleted_at"]) for r in got] == [(100, 5, "a", T1, None), (101, 5, "b", T1, None)]


def test_uploads(spark):
    rows = [(1, 1, "h", T1), (2, 1, "h", T0), (3, 2, "h", T1), (4, 1, "g", T0)]
    up = spark.createDataFrame(rows, "id long, user_id long, file_hash string, created_at timestamp")
    assert sorted(r["id"] for r in ch.first_uploads(up).collect()) == [2, 3, 4]
    assert {r["id"]: r["kept_id"] for r in ch.resolve_uploads(up).collect()} == {1: 2, 2: 2, 3: 3, 4: 4}


def test_palette(spark):
    df = spark.createDataFrame([(1, ["#ab", "#AB", ""]), (1, None), (1, ["#00"]), (2, [])], "brand long, color_palette array<string>")
    assert sorted(tuple(r) for r in ch.merged_palette(df, ["brand"]).collect()) == [(1, "#00"), (1, "#AB")]


def test_seed(spark):
    table = spark.createDataFrame([("a", 1)], "name string, n int")
    seeds = spark.createDataFrame([("a", 2), ("b", 3), ("b", 2)], "name string, n int")
    assert {r["name"]: r["n"] for r in ch.seed_missing(table, seeds, "name").collect()} == {"a": 1, "b": 2}
