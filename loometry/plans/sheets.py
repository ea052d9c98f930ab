"""Sheet ingestion and guarded SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loometry.functions.text import slug
from loometry.operators.lineage import batch_rows
from loometry.operators.changes import replace_by_key
from loometry.plans.registry import query
from loometry.session import cut_lineage, shared_dir
from loometry.sources import sheets as sh
from loometry.sources.tables import read_table, write_table
from loometry.sources.warehouse import Warehouse, column_summary, sample_rows


def messy_sheet(m, name="customers.csv") -> str:
    """The customers as a messy CSV: title, blank line, odd header, an empty
    column, junk cells, rows that are too long, too short or all missing."""
    key = F.col("c_custkey")
    text = key.cast("string")
    comma = F.lit(",")
    regular = F.concat(
        text, comma, F.concat(F.lit('"'), F.replace(F.col("c_name"), F.lit("#"), F.lit(', ""no"" ')), F.lit('"')), comma,
        F.when(key % 20 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string")), comma,
        F.when(key % 10 < 3, "junk").otherwise(F.col("c_acctbal").cast("string")), comma,
        F.when(key % 7 == 0, "").otherwise(F.col("c_nationkey").cast("string")), comma, comma, F.col("c_mktsegment"),
    )
    line = (
        F.when(key % 31 == 30, F.concat(regular, F.lit(",EXTRA")))
        .when(key % 41 == 0, "NA,,null,,,,NaN")
        .when(key % 37 == 0, F.concat(text, F.lit(',"short",12')))
        .otherwise(regular)
    )
    rows = m.raw("customer").select((key + 3).alias("at"), line.alias("value"))
    # Title and header precede the first customer in its own row of the text file.
    head = "Customer export,,,,,,\n\nCust Key,Name!,Acct Bal,acct bal,2nd,,Note\n"
    rows = rows.withColumn("value", F.when(F.col("at") == 3, F.concat(F.lit(head), F.col("value"))).otherwise(F.col("value")))
    path = f"{shared_dir(m.spark, 'upload')}/{name}"
    rows.repartitionByRange(4, "at").sortWithinPartitions("at").select("value").write.text(path)
    return path


SHEET = """sheet AS (SELECT c_custkey, CASE WHEN c_custkey % 41 = 0 THEN NULL ELSE c_custkey::VARCHAR END AS c0,
  CASE WHEN c_custkey % 41 = 0 THEN NULL WHEN c_custkey % 37 = 0 THEN 'short' ELSE replace(c_name, '#', ', "no" ') END AS c1,
  CASE WHEN c_custkey % 41 = 0 THEN NULL WHEN c_custkey % 37 = 0 THEN '12' WHEN c_custkey % 20 = 0 THEN NULL ELSE c_acctbal::VARCHAR END AS c2,
  CASE WHEN c_custkey % 41 = 0 OR c_custkey % 37 = 0 THEN NULL WHEN c_custkey % 10 < 3 THEN 'junk' ELSE c_acctbal::VARCHAR END AS c3,
  CASE WHEN c_custkey % 41 = 0 OR c_custkey % 37 = 0 OR c_custkey % 7 = 0 THEN NULL ELSE c_nationkey::VARCHAR END AS c4,
  CASE WHEN c_custkey % 41 = 0 OR c_custkey % 37 = 0 THEN NULL ELSE c_mktsegment END AS c6
  FROM customer WHERE c_custkey % 31 <> 30)"""

def staged(m):
    return cut_lineage(sh.read_sheet_csv(m.spark, messy_sheet(m)), "sheet")


@query("s1_read_sheet_csv", f"""
WITH {SHEET} SELECT c0, c1, c2, c3, c4, c6 FROM sheet
UNION ALL VALUES ('Customer export', NULL, NULL, NULL, NULL, NULL), ('Cust Key', 'Name!', 'Acct Bal', 'acct bal', '2nd', 'Note')
""")
def s1(m):
    raw = sh.read_sheet_csv(m.spark, messy_sheet(m))
    return raw.select(*[F.col(f"_c{i}").alias(f"c{i}") for i in (0, 1, 2, 3, 4, 6)])


@query("s1_row_index", f"""
WITH {SHEET} SELECT row_number() OVER (ORDER BY pos) - 1 AS row_idx, c0 FROM (
  SELECT c_custkey AS pos, c0 FROM sheet UNION ALL VALUES (-2, 'Customer export'), (-1, 'Cust Key'))
""")
def s1b(m):
    return sh.with_row_index(staged(m)).select("row_idx", F.col("_c0").alias("c0"))


@query("s2_drop_empty", f"""
WITH {SHEET} SELECT c0, c1, c2, c3, c4, c6 AS c5, 6 AS columns FROM sheet WHERE c_custkey % 41 <> 0
UNION ALL VALUES ('Customer export', NULL, NULL, NULL, NULL, NULL, 6), ('Cust Key', 'Name!', 'Acct Bal', 'acct bal', '2nd', 'Note', 6)
""")
def s2(m):
    df = sh.drop_empty(staged(m))
    names = sh.cell_names(df)
    return df.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)], F.lit(len(names)).alias("columns"))


@query("s3_detect_header", f"""
WITH {SHEET} SELECT c0 AS cust_key, c1 AS name, c2 AS acct_bal, c3 AS acct_bal_2, c4 AS c_2nd, c6 AS note FROM sheet WHERE c_custkey % 41 <> 0
""")
def s3(m):
    return sh.with_header(sh.drop_empty(staged(m))).drop(*sh.POSITION)


NUMBERED = """slugs AS (SELECT p_partkey, left(CASE WHEN s = '' THEN 'col' WHEN regexp_matches(s, '^[0-9]') THEN 'c_' || s ELSE s END, 48) AS slug FROM (
  SELECT p_partkey, trim(regexp_replace(lower(trim(coalesce(cell, 'nan'))), '[^0-9a-zA-Z]+', '_', 'g'), '_') AS s FROM (
    SELECT *, CASE WHEN p_size % 9 = 0 THEN ' -- ' WHEN p_size % 11 = 0 THEN NULL WHEN p_size % 5 = 0 THEN 'A' WHEN p_size % 7 = 0 THEN 'a 2' WHEN p_size % 4 = 0 THEN p_size || ' ' || p_name ELSE p_name || '!' END AS cell FROM part)))"""


@query("s4_clean_names", f"""
WITH RECURSIVE {NUMBERED},
heads AS (SELECT p_partkey // 40 AS sheet, list(p_partkey ORDER BY p_partkey) AS keys, list(slug ORDER BY p_partkey) AS slugs FROM slugs GROUP BY 1),
walk(sheet, i, names) AS (
  SELECT sheet, 0, []::VARCHAR[] FROM heads
  UNION ALL SELECT w.sheet, i + 1, list_append(names, CASE WHEN NOT list_contains(names, slugs[i + 1]) THEN slugs[i + 1]
    ELSE list_filter(list_transform(range(2, 50), lambda n: slugs[i + 1] || '_' || n), lambda c: NOT list_contains(names, c))[1] END)
  FROM walk w JOIN heads h ON w.sheet = h.sheet WHERE i < len(slugs))
SELECT w.sheet, unnest(keys) AS p_partkey, unnest(names) AS name FROM walk w JOIN heads h ON w.sheet = h.sheet WHERE i = len(slugs)
""")
def s4(m):
    size = F.col("p_size")
    cell = F.when(size % 9 == 0, " -- ").when(size % 11 == 0, None).when(size % 5 == 0, "A").when(size % 7 == 0, "a 2").when(size % 4 == 0, F.concat(size.cast("string"), F.lit(" "), F.col("p_name"))).otherwise(
        F.concat("p_name", F.lit("!"))
    )
    cells = m.raw("part").select(F.expr("p_partkey div 40").alias("sheet"), "p_partkey", cell.alias("cell"))
    return sh.sheet_names(cells, ["sheet"], "p_partkey")


@query("text_slug", """
SELECT doc_id, left(CASE WHEN s = '' THEN 'col' WHEN regexp_matches(s, '^[0-9]') THEN 'c_' || s ELSE s END, 48) AS slug FROM (
  SELECT doc_id, trim(regexp_replace(lower(trim(text, E' \\t\\n\\r')), '[^0-9a-zA-Z]+', '_', 'g'), '_') AS s FROM documents)
""")
def text_slug(m):
    return m.raw("documents").select("doc_id", slug(F.col("text")).alias("slug"))


@query("s5_coerce_numeric", f"""
WITH {SHEET} SELECT c0::BIGINT AS cust_key, c1 AS name, c2::DOUBLE AS acct_bal, c3 AS acct_bal_2, c4::DOUBLE AS c_2nd, c6 AS note
FROM sheet WHERE c_custkey % 41 <> 0
""")
def s5(m):
    return sh.clean_sheet(staged(m)).drop(*sh.POSITION)


def warehouse(m):
    """A warehouse holding the messy sheet, and the summary of its ingestion."""
    house = Warehouse(m.spark, shared_dir(m.spark, "warehouse"))
    return house, house.ingest(messy_sheet(m, "Customer List.csv"))


TABLE = "up_customer_list"
N_ROWS = "(SELECT count(*) FROM customer WHERE c_custkey % 31 <> 30 AND c_custkey % 41 <> 0)"
COLUMNS = "cust_key,name,acct_bal,acct_bal_2,c_2nd,note"


@query("s6_ingest", f"SELECT '{TABLE}' AS table, 'data' AS sheet, {N_ROWS} AS n_rows, '{COLUMNS}' AS columns, 'Customer List.csv' AS source_file")
def s6(m):
    _, summary = warehouse(m)
    rows = [(s["table"], s["sheet"], s["n_rows"], ",".join(s["columns"]), s["source_file"]) for s in summary]
    return m.spark.createDataFrame(rows, "table string, sheet string, n_rows long, columns string, source_file string")


@query("s7_catalog_upsert", """
SELECT 'brand_' || p_brand AS table_name, CASE WHEN max(p_size) = 50 THEN 'second' ELSE 'first' END AS source_file,
  CASE WHEN max(p_size) = 50 THEN count(*) FILTER (WHERE p_size = 50) ELSE count(*) END AS n_rows FROM part GROUP BY p_brand
""")
def s7(m):
    def entries(df, source):
        return df.groupBy(F.concat(F.lit("brand_"), "p_brand").alias("table_name")).agg(
            F.lit(source).alias("source_file"), F.count(F.lit(1)).alias("n_rows")
        )

    parts = m.raw("part")
    return replace_by_key(entries(parts, "first"), entries(parts.filter("p_size = 50"), "second"), ["table_name"])


@query("s8_list_tables", f"SELECT '{TABLE}' AS table, {N_ROWS} AS n_rows")
def s8(m):
    house, _ = warehouse(m)
    return m.spark.createDataFrame([(t["table"], t["n_rows"]) for t in house.list_tables()], "table string, n_rows long")


@query("s9_describe_table", f"""
SELECT '{TABLE}' AS table, {N_ROWS} AS n_rows, name, type FROM (VALUES ('cust_key', 'bigint'), ('name', 'string'), ('acct_bal', 'double'),
  ('acct_bal_2', 'string'), ('c_2nd', 'double'), ('note', 'string')) v(name, type)
""")
def s9(m):
    house, _ = warehouse(m)
    return column_summary(house.spark.table(TABLE), TABLE)


@query("s9_sample_rows", """
SELECT 'regions' AS table, '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' AS sample FROM region ORDER BY r_regionkey LIMIT 3
""")
def s9_sample(m):
    return sample_rows(m.raw("region").select("r_regionkey", "r_name"), "regions", 3)


@query("s10_run_sql", f"""
WITH {SHEET} SELECT c6 AS note, count(*) AS n, round(avg(c2::DOUBLE), 4) AS mean FROM sheet WHERE c_custkey % 41 <> 0 GROUP BY 1
""")
def s10(m):
    house, _ = warehouse(m)
    out = house.run_sql(f"SELECT note, count(*) AS n, round(avg(acct_bal), 4) AS mean FROM {TABLE} GROUP BY note;", allowed=[TABLE])
    return m.spark.createDataFrame([tuple(r.values()) for r in out["rows"]], "note string, n long, mean double")


@query("l4_bounded_rows", """
SELECT l_returnflag, least(count(DISTINCT l_suppkey), 500) AS row_count, count(DISTINCT l_suppkey) > 500 AS truncated,
  max(l_suppkey) FILTER (WHERE r <= 500) AS last FROM (
  SELECT *, dense_rank() OVER (PARTITION BY l_returnflag ORDER BY l_suppkey) AS r FROM lineitem) GROUP BY 1
UNION ALL SELECT 'ALL', least(count(*), 500), count(*) > 500, max(l_orderkey) FILTER (WHERE r <= 500) FROM (
  SELECT l_orderkey, row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS r FROM lineitem)
""")
def l4(m):
    """The first rows of one statement per ship mode, and of one over all lines."""
    house = Warehouse(m.spark, shared_dir(m.spark, "warehouse"))
    house.register("lineitem", m.raw("lineitem"))
    modes = [r[0] for r in m.raw("lineitem").select("l_returnflag").distinct().collect()]
    texts = {k: f"SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_returnflag = '{k}' ORDER BY k" for k in modes}
    texts["ALL"] = "SELECT l_orderkey AS k FROM lineitem ORDER BY l_orderkey, l_linenumber"
    found = {k: house.run_sql(text) for k, text in texts.items()}
    rows = [(k, out["row_count"], out["truncated"], out["rows"][-1]["k"]) for k, out in found.items()]
    return m.spark.createDataFrame(rows, "l_returnflag string, row_count long, truncated boolean, last long")


@query("f15_table_whitelist", f"SELECT 'allowed' AS case_name, '' AS error, {N_ROWS} AS n UNION ALL SELECT 'blocked', 'query references tables disabled in this session: {TABLE}', NULL UNION ALL SELECT 'empty list', '', {N_ROWS}")
def f15(m):
    house, _ = warehouse(m)
    cases = {"allowed": [TABLE], "blocked": ["other"], "empty list": []}
    found = {name: house.run_sql(f"SELECT count(*) AS n FROM {TABLE}", allowed=a) for name, a in cases.items()}
    rows = [(name, out.get("error", ""), out["rows"][0]["n"] if "rows" in out else None) for name, out in found.items()]
    return m.spark.createDataFrame(rows, "case_name string, error string, n long")


@query("s11_table_scan", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def s11(m):
    path = shared_dir(m.spark, "orders")
    write_table(m.raw("orders"), path)
    return read_table(m.spark, path).groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("s15_batch_rows", """
SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS row_index, '7' AS workspace_id, c_mktsegment AS prompt, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_name END AS aspect_ratio FROM customer
""")
def s15(m):
    key = F.col("c_custkey")
    line = F.concat(F.col("c_mktsegment"), F.lit(",ignored,"), F.when(key % 5 == 0, "").otherwise(F.col("c_name")))
    line = F.when(key == 0, F.concat(F.lit("Prompt ,Other,Aspect  Ratio\n"), line)).otherwise(line)
    path = shared_dir(m.spark, "batch")
    m.raw("customer").select(key, line.alias("value")).repartitionByRange(4, "c_custkey").sortWithinPartitions("c_custkey").select("value").write.text(path)
    raw = cut_lineage(sh.read_sheet_csv(m.spark, path), "batch")
    head = raw.orderBy(*sh.POSITION).limit(1).first()
    rows = sh.with_row_index(raw).filter("row_idx > 0").withColumn("row_idx", F.col("row_idx") - 1)
    named = rows.select("row_idx", *[F.col(c).alias(head[c]) for c in sh.cell_names(raw)])
    args = batch_rows(named, ["prompt", "aspect_ratio"], 7)
    return args.select("row_index", *[F.col("args")[k].alias(k) for k in ("workspace_id", "prompt", "aspect_ratio")])


@query("s1_read_multiline_csv", """
SELECT doc_id::VARCHAR AS c0, replace(replace(text, ' and ', E'\\n'), ' the ', E' "\\n\\n", ') AS c1, source AS c2 FROM documents
""")
def s1_multiline(m):
    """Documents as a sheet whose cells hold line breaks, quotes and commas."""
    broken = F.replace(F.replace(F.col("text"), F.lit(" and "), F.lit("\n")), F.lit(" the "), F.lit(' "\n\n", '))
    cell = F.concat(F.lit('"'), F.replace(broken, F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(",", F.col("doc_id").cast("string"), cell, "source")
    path = f"{shared_dir(m.spark, 'upload')}/notes.csv"
    m.raw("documents").select(line.alias("value")).write.text(path)
    raw = sh.read_sheet_csv(m.spark, path, multiline=True)
    return raw.select(*[F.col(f"_c{i}").alias(f"c{i}") for i in range(3)])
