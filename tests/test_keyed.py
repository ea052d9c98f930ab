"""Bucketed tables: what a change writes, how a reader joins, repeats and conflicts."""

from __future__ import annotations

import datetime as dt
import glob

import pytest
from pyspark.sql import functions as F

from loometry.session import shared_dir
from loometry.sources.keyed import KeyedTable
from loometry.sources.tables import ConcurrentWrite, _claim

SCHEMA = "id long, name string, deleted_at timestamp, deleted_by long, updated_at timestamp"


@pytest.fixture
def table(spark):
    rows = [(i, f"n{i}", None, None, None) for i in range(1000)]
    return KeyedTable.create(spark.createDataFrame(rows, SCHEMA), shared_dir(spark, "keyed"), ["id"], buckets=16)


def now():
    return F.lit(dt.datetime(2024, 1, 1))


def files(table, version):
    return glob.glob(f"{table.path}/changes/v={version}/*/*.parquet")


def state(table):
    return {r.id: r.name for r in table.read().filter("deleted_at IS NULL").collect()}


def test_changes_write_touched_buckets_only(spark, table):
    assert len(glob.glob(f"{table.path}/base/v=0/*.parquet")) == 16
    some = spark.createDataFrame([(3,), (4,), (5000,)], "id long")
    assert table.soft_delete(some, now(), by=7) == 1
    assert len(files(table, 1)) == len({f.split("_bucket=")[1][:2] for f in files(table, 1)}) <= 2
    assert set(range(1000)) - set(state(table)) == {3, 4}
    assert table.restore(spark.createDataFrame([(4,)], "id long")) == 2 and len(files(table, 2)) == 1
    assert table.hard_delete(some) == 3
    assert table.partial_update(spark.createDataFrame([(9, "nine"), (6000, "none")], "id long, name string"), now()) == 4
    assert table.upsert(spark.createDataFrame([(10, "ten"), (2000, "new")], "id long, name string")) == 5
    assert table.insert_ignore(spark.createDataFrame([(11, "x", None, None, None), (2001, "b", None, None, None), (2001, "a", None, None, None)], SCHEMA), [F.col("name")]) == 6
    assert len(files(table, 6)) == 1
    want = {i: f"n{i}" for i in range(1000) if i not in (3, 4)} | {9: "nine", 10: "ten", 2000: "new", 2001: "a"}
    assert state(table) == want
    assert {r.id for r in table.read(upto=1).collect()} == set(range(1000))
    table.compact()
    assert len(glob.glob(f"{table.path}/base/v=6/*.parquet")) == 16 and state(table) == want
    assert table.hard_delete(spark.createDataFrame([(2000,)], "id long")) == 7
    del want[2000]
    assert state(KeyedTable(spark, table.path)) == want


def test_rows_reads_touched_files(spark, table):
    found = table.rows(spark.createDataFrame([(42,)], "id long"))
    assert [r.name for r in found.collect()] == ["n42"] and len(found.inputFiles()) == 1


def test_base_is_joined_where_it_lies(spark, table):
    table.soft_delete(spark.createDataFrame([(i,) for i in range(0, 1000, 2)], "id long"), now())
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = table.read()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Bucketed: true" in plan
        # The only exchanges lie above the changes.
        base = plan[: plan.index("Bucketed: true")].rsplit("SortMergeJoin", 1)[1]
        assert "Exchange" not in base
        assert df.count() == 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_second_writer_fails_and_an_unfinished_change_does_not_count(spark, table):
    _claim(spark, f"{table.path}/changes", 1)
    with pytest.raises(ConcurrentWrite):
        table.hard_delete(spark.createDataFrame([(1,)], "id long"))
    table.write(spark.createDataFrame([(1,)], "id long"), deleted=True, version=2)
    import os

    os.rename(f"{table.path}/changes/v=2/_SUCCESS", f"{table.path}/changes/v=2/_later")
    assert len(state(table)) == 1000


def test_a_repeated_batch_gives_the_same(spark):
    schema = "id long, ts long, name string"
    table = KeyedTable.create(spark.createDataFrame([], schema), shared_dir(spark, "keyed"), ["id"], buckets=4)
    write = table.merge_latest(["ts"])
    first = spark.createDataFrame([(1, 5, "a"), (1, 4, "b"), (2, 1, "c")], schema)
    second = spark.createDataFrame([(1, 3, "late"), (2, 9, "d")], schema)
    for batch, number in ((first, 0), (first, 0), (second, 1), (second, 1)):
        write(batch, number)
    assert sorted(tuple(r) for r in table.read().collect()) == [(1, 5, "a"), (2, 9, "d")]
    assert len(files(table, 2)) == 1
