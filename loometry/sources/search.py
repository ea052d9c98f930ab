"""Contains search that reads only where a pattern can stand.

An index is a written copy of the rows, dealt into parts, and postings: for each three
letters in a row, in which parts they occur. A pattern's letters are looked up, the parts
that hold all of them are read, and every row there is judged by the pattern itself, so
the answer is that of the plain search.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loometry.functions.text import any_contains_ci

#: Letters of a gram.
GRAM = 3
#: Parts of an index, at most: their numbers are collected.
MOST_PARTS = 1 << 14


def grams_of(text: Column) -> Column:
    """The distinct grams of a text in lower case, in time linear in its length."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))


def pattern_grams(spark: SparkSession, pattern: str) -> list[str]:
    """Grams that any text holds which contains the pattern. ``%`` and ``_`` are wild and
    end a run of letters; a backslash takes the next letter as it is."""
    # Lowered as a whole and by Spark, as the comparison itself does.
    lowered = spark.sql("SELECT lower(?)", args=[f"%{pattern}%"]).first()[0]
    runs, escaped = [""], False
    for letter in lowered:
        if letter == "\\" and not escaped:
            escaped = True
        elif letter in "%_" and not escaped:
            runs.append("")
        else:
            runs[-1] += letter
            escaped = False
    return sorted({run[i : i + GRAM] for run in runs for i in range(len(run) - GRAM + 1)})


class TextIndex:
    """Rows under ``path`` with postings of the grams in some of their fields."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        # Written last: an index without it is not finished.
        layout = spark.read.parquet(f"{self.path}/layout").first()
        self.fields, self.parts = list(layout["fields"]), layout["parts"]
        self.schema = T.StructType.fromJson(json.loads(layout["schema"]))

    @classmethod
    def create(cls, df: DataFrame, path: str, keys: Sequence[str], fields: Sequence[str], parts: int | None = None) -> TextIndex:
        """Write and index ``df``, whose ``keys`` are unique; they deal the rows into
        ``parts``, by default four times as many as there are shuffle partitions. Null
        fields hold no letters."""
        spark, path = df.sparkSession, path.rstrip("/")
        parts = parts or min(MOST_PARTS, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
        if not 0 < parts <= MOST_PARTS:
            raise ValueError(f"an index has 1 to {MOST_PARTS} parts")
        placed = df.withColumn("_part", F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(parts)).cast("int"))
        placed.repartition(parts, "_part").write.partitionBy("_part").parquet(f"{path}/rows")
        # Read back, a task has a few whole parts: their pairs are combined before the shuffle.
        schema = placed.schema
        rows = spark.read.schema(schema).parquet(f"{path}/rows")
        found = F.flatten(F.array(*[grams_of(F.coalesce(f"`{f}`", F.lit(""))) for f in fields]))
        pairs = rows.select("_part", F.explode(F.array_distinct(found)).alias("gram")).distinct()
        # In the order of the grams, so that a lookup skips all but a few row groups.
        pairs.repartitionByRange("gram", "_part").sortWithinPartitions("gram", "_part").write.parquet(f"{path}/grams")
        layout = spark.createDataFrame([(list(fields), parts, schema.json())], "fields array<string>, parts int, schema string")
        layout.coalesce(1).write.parquet(f"{path}/layout")
        return cls(spark, path)

    def parts_with(self, pattern: str) -> list[int] | None:
        """Parts whose rows hold all grams of the pattern; None where it has no gram."""
        grams = pattern_grams(self.spark, pattern)
        if not grams:
            return None
        postings = self.spark.read.schema("gram string, _part int").parquet(f"{self.path}/grams")
        held = postings.filter(F.col("gram").isin(grams)).groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
        return sorted(r["_part"] for r in held.filter(F.col("n") == len(grams)).collect())

    def rows(self, parts: Sequence[int] | None = None) -> DataFrame:
        """The rows of some parts, or all; other parts' files are not opened."""
        found = self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")
        if parts is not None:
            found = found.filter(F.col("_part").isin(list(parts)) if parts else F.lit(False))
        return found.drop("_part")

    def search(self, pattern: str) -> DataFrame:
        """Rows one of whose fields contains the pattern in any case. Patterns without
        three letters in a row are looked for everywhere."""
        return self.rows(self.parts_with(pattern)).filter(any_contains_ci([F.col(f"`{f}`") for f in self.fields], pattern))
