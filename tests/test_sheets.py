from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loometry.functions.text import parse_number
from loometry.sources import sheets as sh
from loometry.sources.tables import ConcurrentWrite, read_table, table_names, write_table
from loometry.sources.warehouse import Warehouse, first_rows_of
from loometry.session import cut_lineage


def sheet(spark, tmp_path, text, name="a.csv", **options):
    path = tmp_path / name
    path.write_text(text)
    return cut_lineage(sh.read_sheet_csv(spark, str(path), **options))


def cells(df):
    names = sh.cell_names(df)
    return [tuple(r) for r in df.orderBy(*sh.POSITION).select(*names).collect()]


def test_reader_pads_short_and_drops_long_rows(spark, tmp_path):
    df = sheet(spark, tmp_path, 'a,b,c\n\n   \n1,2\n1,2,3,4\n"x, ""y""",NA,""\nn/a,None,z\n' + "p,q,r\n" * 8 + "1,2,3,4\n")
    assert cells(df)[:1] == [("a", "b", "c", None)]  # a longer row among the first makes the sheet wider
    narrow = sheet(spark, tmp_path, "a,b,c\n1,2\n" + "p,q,r\n" * 8 + '1,2,3,4\n"x, ""y""",NA,""\nn/a,None,z\n', "b.csv")
    assert cells(narrow) == [("a", "b", "c"), ("1", "2", None)] + [("p", "q", "r")] * 8 + [('x, "y"', None, None), (None, None, "z")]


def test_one_cell_title_does_not_lose_the_sheet(spark, tmp_path):
    df = sheet(spark, tmp_path, "Report 2024\nName,Age\nann,1\nbob,2\n")
    clean = sh.clean_sheet(df)
    assert sh.cell_names(clean) == ["name", "age"]
    assert cells(clean) == [("ann", 1.0), ("bob", 2.0)]


def test_multiline_cells(spark, tmp_path):
    df = sheet(spark, tmp_path, 'a,b\n"one\ntwo",1\n"three",2\n', multiline=True)
    assert cells(df) == [("a", "b"), ("one\ntwo", "1"), ("three", "2")]


def test_rows_keep_their_order_over_splits(spark, tmp_path):
    path = tmp_path / "big.csv"
    path.write_text("id,x\n" + "".join(f"{i},{'y' * 50}\n" for i in range(4000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        raw = cut_lineage(sh.read_sheet_csv(spark, str(path)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert raw.select("_block").distinct().count() > 5
    rows = sh.with_row_index(raw).orderBy("row_idx").collect()
    assert [r["row_idx"] for r in rows] == list(range(4001))
    assert [r["_c0"] for r in rows] == ["id"] + [str(i) for i in range(4000)]


def test_header_is_the_fullest_early_row(spark, tmp_path):
    df = sheet(spark, tmp_path, "x,,\nA,B,C\n1,2,3\n4,5,6\n")
    head = sh.detect_header(sh.drop_empty(df))
    assert [head["_c0"], head["_c1"]] == ["A", "B"]  # ties go to the earliest


def test_header_after_the_eighth_row_is_not_looked_for(spark, tmp_path):
    df = sheet(spark, tmp_path, "a,b\n" + "1,\n" * 9 + "1,2\n")
    assert sh.cell_names(sh.clean_sheet(df)) == ["a", "b"]


def test_names(spark):
    assert sh.clean_names(spark, ["Cust Key!", " cust-key", None, None, "2nd", "--", "A_2", "a", "a"]) == [
        "cust_key", "cust_key_2", "nan", "nan_2", "c_2nd", "col", "a_2", "a", "a_3",
    ]
    assert sh.clean_names(spark, ["A", "a", "A 2", None]) == ["a", "a_2", "a_2_2", "nan"]
    assert sh.clean_names(spark, ["x" * 60]) == ["x" * 48]
    assert sh.clean_names(spark, ["9" + "x" * 60]) == ["c_9" + "x" * 45]


def test_whole_numbers_stay_whole(spark, tmp_path):
    ids = [9007199254740993 + i for i in range(5)]
    body = "".join(f"{i},{i % 3},{'' if n == 2 else 7}\n" for n, i in enumerate(ids))
    clean = sh.clean_sheet(sheet(spark, tmp_path, "id,part,gap\n" + body))
    assert dict(clean.drop(*sh.POSITION).dtypes) == {"id": "bigint", "part": "bigint", "gap": "double"}
    assert sorted(r["id"] for r in clean.collect()) == ids


def test_head_of_odd_sheets(spark, tmp_path):
    assert sh.cell_names(sheet(spark, tmp_path, "a,b\n1,2\n" + "\n" * 100000, "tail.csv")) == ["_c0", "_c1"]
    (tmp_path / "quote.csv").write_text('a,b\n"never ends' + "\nx,y" * 50000)
    with pytest.raises(ValueError, match="does not end|do not end"):
        sh.read_sheet_csv(spark, str(tmp_path / "quote.csv"))
    (tmp_path / "long.csv").write_text("a,b\n" + "x" * 1100000)
    with pytest.raises(ValueError, match="characters"):
        sh.read_sheet_csv(spark, str(tmp_path / "long.csv"))


def test_nothing_usable(spark, tmp_path):
    assert sh.clean_sheet(sheet(spark, tmp_path, "NA,,null\n,,\n")) is None
    assert sh.clean_sheet(sheet(spark, tmp_path, "only,a,header\n", "h.csv")) is None


@pytest.mark.parametrize("good, numeric", [(79, False), (80, True)])
def test_numeric_share(spark, tmp_path, good, numeric):
    body = "".join("7,k\n" if i < good else ("junk,k\n" if i % 2 else ",k\n") for i in range(100))
    clean = sh.clean_sheet(sheet(spark, tmp_path, "v,k\n" + body))
    assert dict(clean.dtypes)["v"] == ("double" if numeric else "string")
    if numeric:
        assert clean.filter("v is null").count() == 20


def test_parse_number(spark):
    cases = {
        "12": 12.0, " 12 ": 12.0, "1e3": 1000.0, "+5": 5.0, ".5": 0.5, "5.": 5.0, "12\t": 12.0, "-0.25": -0.25,
        "inf": float("inf"), "-Infinity": float("-inf"),
        "1d": None, "1f": None, "1,000": None, "0x10": None, "1_000": None, "1e400": None, "": None, "abc": None, "+": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    got = {r["s"]: r["v"] for r in df.select("s", parse_number(F.col("s")).alias("v")).collect()}
    assert got == cases


@pytest.fixture()
def house(spark, tmp_path):
    made = Warehouse(spark, str(tmp_path / "guarded"))
    made.register("up_open", spark.range(3))
    made.register("up_secret", spark.range(5))
    made.register("uploads_catalog", spark.range(1))
    return made


def test_gate_lets_queries_pass(house):
    for text in (" select 1 ; ", "WITH t AS (SELECT 1 AS a) SELECT * FROM t", "select 'call; drop' AS settle", "SELECT count(*) FROM up_open, range(4)",
                 "SELECT * FROM (VALUES (1), (2)) v(a)", "FROM up_open SELECT id", "SELECT * FROM uploads_catalog"):
        assert "rows" in house.run_sql(text, allowed=["up_open"]), text


def test_gate_refuses(house):
    cases = {
        "single statement": ["select 1; select 2"],
        "SELECT/WITH": ["", "show tables", "drop table up_open", "insert into up_open values (1)", "set a=b", "cache table up_open", "with t as (select 1) insert into up_open select * from t", "create temp view x as select 1", "explain select 1"],
        "forbidden": ["select reflect('java.lang.System', 'exit', 1)", "select 1 where exists (select java_method('a', 'b'))", "SELECT * FROM IDENTIFIER('up_' || 'secret')",
                      "SELECT IDENTIFIER('reflect')('java.lang.System', 'exit', 1)", "WITH t AS (SELECT * FROM IDENTIFIER('up_secret')) SELECT * FROM t"],
        "disabled in this session: up_secret": ["select * from up_secret", "SELECT * FROM up_open WHERE id IN (SELECT id FROM up_secret)", "WITH a AS (WITH b AS (SELECT * FROM up_secret) SELECT * FROM b) SELECT * FROM a",
                                               "SELECT (SELECT max(id) FROM UP_SECRET) FROM up_open", "SELECT * FROM up_open, LATERAL (SELECT * FROM up_secret) s"],
    }
    for reason, texts in cases.items():
        for text in texts:
            assert reason in house.run_sql(text, allowed=["up_open"]).get("error", ""), (text, house.run_sql(text, allowed=["up_open"]))


def test_two_warehouses_do_not_share_tables_or_settings(spark, tmp_path):
    before = spark.conf.get("spark.sql.runSQLOnFiles")
    a, b = Warehouse(spark, str(tmp_path / "a")), Warehouse(spark, str(tmp_path / "b"))
    for house, n in ((a, 5), (b, 1)):
        path = tmp_path / "Same.csv"
        path.write_text("k,v\n" + "x,1\n" * n)
        house.ingest(str(path))
    assert [h.run_sql("SELECT count(*) AS n FROM up_same")["rows"] for h in (a, b)] == [[{"n": 5}], [{"n": 1}]]
    assert spark.conf.get("spark.sql.runSQLOnFiles") == before and not spark.catalog.tableExists("up_same")
    spark.range(1).createOrReplaceTempView("other_session_table")
    assert "error" in a.run_sql("SELECT * FROM other_session_table")


def test_warehouse(spark, tmp_path):
    path = tmp_path / "My Sheet.csv"
    path.write_text("Name,Score\nann,1\nbob,2\n")
    house = Warehouse(spark, str(tmp_path / "house"))
    assert house.ingest(str(path)) == [
        {"table": "up_my_sheet", "sheet": "data", "n_rows": 2, "columns": ["name", "score"], "source_file": "My Sheet.csv"}
    ]
    path.write_text("Name,Score\nann,1\nbob,2\ncid,3\n")
    house.ingest(str(path))
    assert house.list_tables() == [{"table": "up_my_sheet", "n_rows": 3}]
    catalog = read_table(spark, str(tmp_path / "house" / "uploads_catalog")).collect()
    assert [(r["table_name"], r["n_rows"], r["n_cols"], r["columns"]) for r in catalog] == [("up_my_sheet", 3, 2, "name,score")]
    told = house.describe_table("up_my_sheet")
    assert told["columns"] == [{"name": "name", "type": "string"}, {"name": "score", "type": "bigint"}]
    assert told["n_rows"] == 3 and len(told["sample"]) == 3
    assert "unknown table" in house.describe_table("nope")["error"]
    assert "disabled" in house.describe_table("up_my_sheet", ["other"])["error"]
    out = house.run_sql("SELECT name FROM up_my_sheet ORDER BY score DESC", max_rows=2)
    assert out["rows"] == [{"name": "cid"}, {"name": "bob"}] and out["truncated"] and out["row_count"] == 2
    assert "error" in house.run_sql("SELECT nope FROM up_my_sheet")
    assert "error" in house.run_sql(f"SELECT * FROM parquet.`{tmp_path}/house/up_my_sheet/v=1`")
    spark.range(3).createOrReplaceTempView("secret")
    for hidden in ("SELECT * FROM secret", "SELECT 1 WHERE EXISTS (SELECT 1 FROM secret)", "WITH x AS (SELECT * FROM secret) SELECT * FROM x",
                   "SELECT * FROM default.up_my_sheet", "SELECT * FROM global_temp.secret"):
        assert "error" in house.run_sql(hidden), hidden
    assert house.run_sql("WITH x AS (SELECT * FROM up_my_sheet) SELECT count(*) AS n FROM x")["rows"] == [{"n": 3}]
    # A second session over the same folder finds the table again.
    assert Warehouse(spark, str(tmp_path / "house")).tables() == ["up_my_sheet"]
    with pytest.raises(ValueError, match="unsupported"):
        house.ingest(str(tmp_path / "a.txt"))
    (tmp_path / "empty.csv").write_text("NA\n")
    with pytest.raises(ValueError, match="no usable data"):
        house.ingest(str(tmp_path / "empty.csv"))


def test_bounded(spark):
    assert first_rows_of(spark.range(5), 5)["truncated"] is False
    assert first_rows_of(spark.range(6), 5)["truncated"] is True


def test_unfinished_version_is_ignored(spark, tmp_path):
    root = str(tmp_path / "t")
    write_table(spark.range(3), root)
    (tmp_path / "t" / "v=2").mkdir()
    assert read_table(spark, root).count() == 3
    assert write_table(spark.range(4), root).count() == 4
    assert table_names(spark, str(tmp_path)) == ["t"]
    assert read_table(spark, str(tmp_path / "none")) is None


def test_a_version_has_one_writer(spark, tmp_path):
    root = str(tmp_path / "t")
    write_table(spark.range(3), root)
    (tmp_path / "t" / "_claims" / "2").write_text("")
    with pytest.raises(ConcurrentWrite, match="version 2"):
        write_table(spark.range(4), root)
    (tmp_path / "t" / "_claims" / "2").unlink()
    broken = spark.range(1).select(F.raise_error(F.lit("no")).alias("x"))
    with pytest.raises(Exception, match="no"):
        write_table(broken, root)
    assert write_table(spark.range(4), root).count() == 4
