"""Reading messy CSV sheets into clean, typed tables.

A sheet is one CSV file, or a folder of part files whose names give their
order. It may be any size: its rows are numbered without bringing them
together, and only facts about its columns (names, counts, the first rows)
reach the driver.
"""

from __future__ import annotations

import csv
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loometry import fixed
from loometry.functions.text import is_missing_cell, parse_number, parse_whole, slug
from loometry.operators.scans import scan
from loometry.sources.records import POSITION, read_records

#: Lines read for the head of a sheet, more only where cells span lines; and characters of a line.
HEAD_LINES = (64, 4096)
LINE_CHARACTERS = 1 << 20


def _head_records(spark: SparkSession, path: str, n: int = fixed.HEADER_SEARCH_ROWS) -> list[list[str]]:
    """The first ``n`` non-blank records of the sheet, for its shape only.

    Lines come from the first block of the first files, in the order of their names.
    A line or a quoted cell that goes on past the bounds below is an error.
    """
    records: list[list[str]] = []
    for file in sorted(unquote(f) for f in spark.read.text(path).inputFiles()):
        value = F.col("value")
        lines = spark.read.text(file).filter((F.col("_metadata.file_block_start") == 0) & (F.btrim(value, F.lit(fixed.WHITESPACE)) != ""))
        for count in HEAD_LINES:
            first = [r[0] for r in lines.select(F.substring(value, 1, LINE_CHARACTERS + 1)).limit(count).collect()]
            if any(len(line) > LINE_CHARACTERS for line in first):
                raise ValueError(f"a line of the sheet's head has more than {LINE_CHARACTERS} characters")
            try:
                found = list(csv.reader([line + "\n" for line in first], strict=False))
            except csv.Error as error:
                raise ValueError(f"a quoted cell of the sheet's head does not end: {error}") from error
            # The last record may go on in lines not yet read.
            if len(found) > n - len(records) or len(first) < count:
                break
        else:
            raise ValueError(f"the first {n} records of the sheet do not end within {HEAD_LINES[-1]} lines")
        records += found
        if len(records) >= n:
            break
    return records[:n]


def read_sheet_csv(spark: SparkSession, path: str, *, multiline: bool = False) -> DataFrame:
    """All cells as strings (``_c0``, ``_c1``, ...), with the position of each row.

    Blank lines are skipped, rows with more cells than the sheet has columns are
    dropped, short rows are padded with nulls, missing-value words become null.
    The width is that of the widest of the first rows: the first row alone would
    let a one-cell title line make every real row too long.

    ``multiline`` allows line breaks inside quoted cells (see ``read_records``); the
    lines are then written once to the shared folder, still read in many tasks.
    """
    width = max((len(r) for r in _head_records(spark, path)), default=1)
    # One column more than the sheet has catches the rows that are too long.
    names = [f"_c{i}" for i in range(width + 1)]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    options = {"mode": "PERMISSIVE", "header": "false", "escape": '"'}
    if multiline:
        record = F.from_csv("value", ", ".join(f"{n} string" for n in names), options)
        placed = read_records(spark, path).select(*POSITION, record.alias("_record")).select(*POSITION, "_record.*")
    else:
        placed = spark.read.schema(schema).options(**options).csv(path).select(
            F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_seq"), *names,
        )
    cells = [F.when(~is_missing_cell(F.col(n)), F.col(n)).alias(n) for n in names[:-1]]
    return placed.filter(F.col(names[-1]).isNull()).select(*POSITION, *cells)


def cell_names(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in POSITION]


def with_row_index(df: DataFrame, name: str = "row_idx") -> DataFrame:
    """Number the rows of a sheet from 0. Each file block counts its own rows;
    only one total per block is brought together."""
    block = F.struct("_file", "_block")
    return scan(df, [], POSITION, block, number="_n").select(
        (F.col("_n") - 1).alias(name), *cell_names(df)
    )


def drop_empty(df: DataFrame) -> DataFrame:
    """Without the columns, then the rows, that hold nothing."""
    names = cell_names(df)
    counts = df.agg(*[F.count(c).alias(c) for c in names]).first()
    kept = [c for c in names if counts[c] > 0]
    return df.select(*[c for c in df.columns if c in POSITION], *kept).na.drop("all", subset=kept or None)


def unique_names(slugs: Column) -> Column:
    """An array of names with repeats told apart: each gets the first of ``_2``, ``_3``,
    ... that no name before it has."""
    def place(names: Column, name: Column) -> Column:
        numbered = F.transform(F.sequence(F.lit(2), F.size(names) + 2), lambda n: F.concat(name, F.lit("_"), n.cast("string")))
        free = F.filter(numbered, lambda candidate: ~F.array_contains(names, candidate))
        return F.array_append(names, F.when(F.array_contains(names, name), F.get(free, F.lit(0))).otherwise(name))

    return F.aggregate(slugs, F.array().cast("array<string>"), place)


def header_names(cells: Column) -> Column:
    """Column names from an array of header cells; an empty cell reads ``nan``."""
    return unique_names(F.transform(cells, lambda cell: slug(F.coalesce(cell, F.lit("nan")))))


def clean_names(spark: SparkSession, cells: list[str | None]) -> list[str]:
    """``header_names`` of one sheet."""
    row = spark.createDataFrame([(cells,)], "cells array<string>")
    return row.select(header_names(F.col("cells"))).first()[0]


def header_scores(df: DataFrame) -> Column:
    """Cells of a row that hold something."""
    score = F.lit(0)
    for name in cell_names(df):
        score = score + F.col(name).isNotNull().cast("int")
    return score


def detect_header(df: DataFrame):
    """The fullest of the first rows; the earliest of equals."""
    first = df.select("*", header_scores(df).alias("_score")).orderBy(*POSITION).limit(fixed.HEADER_SEARCH_ROWS)
    return first.orderBy(F.desc("_score"), *POSITION).limit(1).first()


def with_header(df: DataFrame) -> DataFrame:
    """Named columns and the rows below the header."""
    head = detect_header(df)
    if head is None:
        return df.filter(F.lit(False))
    names = cell_names(df)
    titles = clean_names(df.sparkSession, [head[c] for c in names])
    position = F.struct(*[F.col(c) for c in POSITION])
    below = position > F.struct(*[F.lit(head[c]).alias(c) for c in POSITION])
    return df.filter(below).select(*POSITION, *[F.col(c).alias(t) for c, t in zip(names, titles)])


def coerce_numeric(df: DataFrame, share: float = fixed.NUMERIC_SHARE) -> DataFrame:
    """Columns turn numeric when at least ``share`` of all rows parse; cells that
    do not parse turn null. A column whose every cell is a whole number keeps them
    whole. One pass counts every column."""
    names = cell_names(df)
    cells = [F.col(f"`{c}`") for c in names]
    counts = df.agg(
        F.count(F.lit(1)).alias("all"), F.array(*[F.count(parse_number(c)) for c in cells]).alias("numbers"),
        F.array(*[F.count(parse_whole(c)) for c in cells]).alias("whole"),
    ).first()
    total, out = counts["all"], {}
    for name, cell, numbers, whole in zip(names, cells, counts["numbers"], counts["whole"], strict=True):
        if total and whole == total:
            out[name] = parse_whole(cell)
        elif total and numbers and numbers / total >= share:
            out[name] = parse_number(cell)
    return df.select(*[out[c].alias(c) if c in out else F.col(f"`{c}`") for c in df.columns])


def clean_sheet(df: DataFrame) -> DataFrame | None:
    """Header found, empty rows and columns gone, numbers typed; null when
    nothing is left. ``df`` must give the same rows and positions every time it
    is read, so pass a written table (see ``Warehouse.ingest``)."""
    filled = drop_empty(df)
    if not cell_names(filled):
        return None
    named = with_header(filled)
    named = named.na.drop("all", subset=cell_names(named))
    if named.isEmpty():
        return None
    return coerce_numeric(named)


def sheet_names(cells: DataFrame, keys: list[str], order: str, cell: str = "cell") -> DataFrame:
    """``keys, order, name`` for the header cells of many sheets at once. A sheet's
    cells are one array: as many as it has columns."""
    heads = cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, cell))).alias("_cells"))
    named = heads.withColumn("_names", header_names(F.col("_cells")[cell]))
    pairs = named.select(*keys, F.inline(F.arrays_zip(F.col("_cells")[order].alias(order), F.col("_names").alias("name"))))
    return pairs.toDF(*keys, order, "name")
