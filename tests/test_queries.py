"""Every registered query against its SQL twin."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

import __spark_entry__ as contract
from loometry.plans import catalog

QUERIES, ORACLE = catalog.QUERIES, catalog.ORACLE


@pytest.fixture(scope="module")
def duck(data_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{data_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return repr(value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in rows], key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(name, spark, data_dir, duck):
    df = QUERIES[name](spark, data_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert name in ORACLE, "every query has a SQL twin"
    cursor = duck.execute(ORACLE[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert got == rows_of(columns, cursor.fetchall())


def test_flagship(spark):
    assert contract.entry(spark).count() == 10
