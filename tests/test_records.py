"""Records over several lines and blocks against a reading in one piece."""

from __future__ import annotations

import csv
import random

import pytest

from loometry.sources import sheets as sh
from loometry.sources.records import read_records
from loometry.sources.warehouse import Warehouse


@pytest.fixture
def small_blocks(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def cells(df):
    return [tuple(r) for r in df.orderBy(*sh.POSITION).select(*sh.cell_names(df)).collect()]


def odd_cell(rng):
    return "".join(rng.choice(['"', "\n", ",", "a", "b c", '""', "\n\n", "x" * 40, "é", " "]) for _ in range(rng.randint(1, 8)))


def as_line(row):
    return ",".join('"' + c.replace('"', '""') + '"' if any(x in c for x in '",\n') else c for c in row)


@pytest.mark.parametrize("seed", range(3))
def test_equals_a_reading_in_one_piece(spark, tmp_path, small_blocks, seed):
    rng = random.Random(seed)
    rows = [[f"id{i}", odd_cell(rng), odd_cell(rng)] for i in range(300)]
    text = "".join(as_line(r) + "\n" + "\n" * (rng.random() < 0.1) for r in rows)
    (tmp_path / "a.csv").write_text(text)
    want = [tuple(r) for r in csv.reader(text.splitlines(keepends=True)) if r]
    assert want == [tuple(r) for r in rows]
    raw = sh.read_sheet_csv(spark, str(tmp_path / "a.csv"), multiline=True)
    assert raw.select("_block").distinct().count() > 10
    assert cells(raw) == [tuple(c or None for c in r) for r in want]
    whole = spark.read.option("escape", '"').option("multiLine", "true").schema("a string, b string, c string").csv(str(tmp_path / "a.csv"))
    assert [tuple(r) for r in whole.collect()] == cells(raw)


def test_a_cell_over_many_blocks(spark, tmp_path, small_blocks):
    long = "\n".join(f"line {i}, said ""x""" for i in range(400))
    (tmp_path / "a.csv").write_text('k,v\n1,"' + long + '"\n2,"b"\n3,un"quoted\n4,"a"b"c\n5,""\n')
    got = cells(sh.read_sheet_csv(spark, str(tmp_path / "a.csv"), multiline=True))
    assert got[:4] == [("k", "v"), ("1", long), ("2", "b"), ("3", 'un"quoted')]
    assert [r[0] for r in got[4:]] == ["4", "5"] and got[5] == ("5", None)


def test_line_ends_and_several_files(spark, tmp_path):
    folder = tmp_path / "parts"
    folder.mkdir()
    (folder / "p0.csv").write_bytes(b'a,b\r\n1,"x\r\ny"\r\n')
    (folder / "p1.csv").write_bytes(b'2,"z"\n\n  \n3,"\n"\n')
    got = cells(sh.read_sheet_csv(spark, str(folder), multiline=True))
    assert got == [("a", "b"), ("1", "x\ny"), ("2", "z"), ("3", "\n")]


def test_open_quote_takes_the_rest_within_bounds(spark, tmp_path, small_blocks):
    path = tmp_path / "a.csv"
    path.write_text("a,b\n" * 20 + '1,"never ends\n' + "x,y\n" * 500)
    records = read_records(spark, str(path)).orderBy(*sh.POSITION).collect()
    assert len(records) == 21 and records[-1]["value"] == '1,"never ends' + "\nx,y" * 500
    with pytest.raises(ValueError, match="may not end"):
        read_records(spark, str(path), most=1000)


def test_long_line_and_empty_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a," + '"q","" ,' * 150000 + '"open\nclosed"\n')
    assert [len(r["value"]) for r in read_records(spark, str(tmp_path / "a.csv")).collect()] == [2 + 8 * 150000 + 13]
    (tmp_path / "b.csv").write_text("")
    assert read_records(spark, str(tmp_path / "b.csv")).count() == 0


def test_ingest(spark, tmp_path):
    (tmp_path / "Notes.csv").write_text('Id,Note\n1,"two\nlines"\n2,one\n')
    house = Warehouse(spark, str(tmp_path / "house"))
    assert house.ingest(str(tmp_path / "Notes.csv"), multiline=True)[0]["n_rows"] == 2
    assert [r["note"] for r in house.spark.table("up_notes").orderBy("id").collect()] == ["two\nlines", "one"]


def test_a_block_of_many_lines_is_no_single_chunk(spark, tmp_path, monkeypatch):
    from loometry.sources import records

    (tmp_path / "a.csv").write_text("".join(f'{i},"a\n\n""b""\nc"\n' for i in range(500)))
    chunks, real = [], records.scan

    def scanned(df, keys, order, chunk, **asked):
        chunks.append(df.groupBy(*keys, chunk.alias("_chunk")).count().agg({"count": "max"}).first()[0])
        return real(df, keys, order, chunk, **asked)

    monkeypatch.setattr(records, "scan", scanned)
    monkeypatch.setattr(records, "CHUNK_LINES", 64)
    rows = read_records(spark, str(tmp_path / "a.csv")).orderBy(*sh.POSITION).collect()
    assert [r["value"] for r in rows] == [f'{i},"a\n\n""b""\nc"' for i in range(500)]
    assert len(chunks) == 3 and max(chunks) <= 64
