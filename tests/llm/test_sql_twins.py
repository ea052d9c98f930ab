"""The queries that SQL can express, against their SQL."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from loometry.llm.queries import ORACLE, QUERIES
from tests.test_queries import rows_of


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(name, spark, data_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{data_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = QUERIES[name](spark, data_dir)
    cursor = con.execute(ORACLE[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, cursor.fetchall())
