"""Clustered tables skip what a lookup can not need."""

from __future__ import annotations

from pyspark.sql import functions as F

from loometry.sources.tables import read_table, write_table


def rows_read(df):
    """Rows that the scan gives to the plan, and the result."""
    found = df.collect()
    scan = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    return scan.metrics().apply("numOutputRows").value(), found


def rows(spark, n=80000):
    # A third of all rows share one group; keys are in no order.
    key = F.col("id") * 7919 % n
    group = F.when(F.col("id") % 3 == 0, 5).otherwise(key % 1000)
    return spark.range(0, n, numPartitions=8).select(key.alias("key"), group.alias("group"), F.create_map(F.lit("a"), "id").alias("m"))


def test_lookups_skip_files(spark, tmp_path):
    n = 80000
    # Spark would put so few rows into one file.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_table(rows(spark), str(tmp_path / "t"), by=["group"], lookups=["key"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    table = read_table(spark, str(tmp_path / "t"))
    assert table.count() == n and table.select("key").distinct().count() == n
    files = table.select("group", F.input_file_name().alias("f"))
    assert files.select("f").distinct().count() == 8
    # The group that a third of all rows share lies in several files of about one size.
    sizes = [r["count"] for r in files.groupBy("f").count().collect()]
    assert max(sizes) < 2 * min(sizes)
    assert files.filter("group = 5").select("f").distinct().count() > 1
    read, found = rows_read(table.filter("key = 4242"))
    assert len(found) == 1 and read < n / 3
    read, found = rows_read(table.filter("group = 990"))
    assert {r["group"] for r in found} == {990} and read < n / 3
    read, found = rows_read(table.filter("key IN (-4, 900000)"))
    assert found == [] and read == 0


def test_bloom_filter_alone(spark, tmp_path):
    """Long keys whose range covers every file, too many for a dictionary."""
    wide = spark.range(0, 400000, numPartitions=4).select(F.sha2(F.col("id").cast("string"), 256).alias("key"))
    write_table(wide, str(tmp_path / "t"), lookups=["key"])
    table = read_table(spark, str(tmp_path / "t"))
    wanted = wide.limit(1).first()["key"]
    read, found = rows_read(table.filter(F.col("key") == wanted))
    assert [r["key"] for r in found] == [wanted] and read <= 200000
    write_table(wide, str(tmp_path / "plain"))
    assert rows_read(read_table(spark, str(tmp_path / "plain")).filter(F.col("key") == wanted))[0] > read


def test_null_keys_empty_tables_and_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(None, "a"), (1, None), (1, None), (2, "b")], "`k.x` long, v string")
    write_table(df, path, by=["k.x"])
    assert sorted(map(str, read_table(spark, path).collect())) == sorted(map(str, df.collect()))
    write_table(df.limit(0), path, by=["k.x"], lookups=["v"])
    assert read_table(spark, path).count() == 0 and read_table(spark, path).columns == df.columns
