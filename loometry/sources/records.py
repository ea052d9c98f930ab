"""Records of delimited text whose quoted cells may hold line breaks.

Such a file can be read in many tasks: a line maps the state before it (outside or
inside a quoted cell) to the state after it. There are four such maps (stay, turn,
close, open), so the state at any line follows from the last line that closes or opens
whatever came before, and from the parity of the turns since. Both are running values,
carried from block to block by ``scan`` on the flags of the lines alone; only lines of
records that span several are brought together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loometry import fixed
from loometry.operators.scans import chunk_of, scan
from loometry.session import cut_lineage

POSITION = ["_file", "_block", "_seq"]
#: Characters of a record, at most: a quote that never ends takes the rest of its file.
RECORD_CHARACTERS = 1 << 26
#: Lines of a chunk of ``scan``, and of a task: a file block may hold millions of short
#: ones, whose flags take hundreds of bytes each when sorted and next to none compressed.
CHUNK_LINES, TASK_LINES = 1 << 15, 1 << 18

# All loops are possessive: Java's matcher then needs no stack, however long the line.
_QUOTED = '"[^"]*+(?:""[^"]*+)*+'
_ENDS_INSIDE = rf'\A(?:(?:{_QUOTED}"[^,]*+|(?!")[^,]*+),)*+{_QUOTED}\z'


def ends_inside(line: Column) -> Column:
    """Whether a line that begins outside a quoted cell ends inside one. A quote opens a
    cell as its first character only; two quotes inside stand for one."""
    return line.rlike(_ENDS_INSIDE)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their position, and the state after each from either state before it."""
    value = F.col("value")
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_seq"), "value",
    )
    # A line that begins inside a cell reads as if the cell's quote stood before it.
    lines = lines.withColumn("_out", ends_inside(value)).withColumn("_in", ends_inside(F.concat(F.lit('"'), value)))
    # Written once: every later step sees the same positions.
    return cut_lineage(lines, "lines")


def _tasks(lines: DataFrame) -> int:
    """Tasks for the lines of a written table."""
    return max(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), lines.count() // TASK_LINES)


def _last_lines(lines: DataFrame, tasks: int) -> DataFrame:
    """``_file, _block, _seq`` of each line and ``_end``, the place of the line that ends
    its record; null where the file ends first."""
    stay, turn = ~F.col("_out") & F.col("_in"), F.col("_out") & ~F.col("_in")
    turns = F.col("_turns") % 2
    flags = lines.select(*POSITION, "_out", "_in")
    order, chunk = ["_block", "_seq"], F.struct("_block", chunk_of("_seq", CHUNK_LINES).alias("_lines"))
    flags = scan(flags, ["_file"], order, chunk, counts={"_turns": turn}, parts=tasks)
    set_to = F.when(~stay & ~turn, F.col("_out").cast("long").bitwiseXOR(turns))
    flags = scan(flags, ["_file"], order, chunk, last={"_set": set_to}, parts=tasks)
    inside = F.coalesce("_set", F.lit(0)).bitwiseXOR(turns) == 1
    # Backwards, the latest line that ends outside is the next one at or after this.
    back = flags.select(*POSITION, (-F.col("_block")).alias("_b"), (-F.col("_seq")).alias("_s"), inside.alias("_inside"))
    end = F.when(~F.col("_inside"), F.struct("_block", "_seq"))
    chunk = F.struct("_b", chunk_of("_s", CHUNK_LINES).alias("_lines"))
    return scan(back, ["_file"], ["_b", "_s"], chunk, last={"_end": end}, parts=tasks).select(*POSITION, "_end")


def read_records(spark: SparkSession, path: str, *, most: int = RECORD_CHARACTERS) -> DataFrame:
    """``_file, _block, _seq, value``: one row per record, at the place of its first line.

    Lines end with ``\\n``, ``\\r\\n`` or ``\\r``; inside a cell each reads ``\\n``. Blank
    lines between records are skipped. A quote that never ends takes the rest of its
    file; a record of more than ``most`` characters is an error.
    """
    lines = _lines(spark, path)
    tasks = _tasks(lines)
    ends = cut_lineage(_last_lines(lines, tasks), "ends")
    here = F.struct("_block", "_seq")
    early = ends.filter(F.col("_end").isNull() | (F.col("_end") != here))
    # The members of records of several lines: all but their last line, and that one.
    late = early.filter(F.col("_end").isNotNull()).select("_file", "_end._block", "_end._seq", "_end").distinct()
    members = early.unionByName(late)
    blank = F.btrim("value", F.lit(fixed.WHITESPACE)) == ""
    single = lines.join(members, POSITION, "left_anti").filter(~blank).select(*POSITION, "value")
    parts = lines.select(*POSITION, "value").join(members, POSITION)
    # The totals are combined before they are shuffled, so an endless record is found by
    # its length and never brought together.
    longest = parts.groupBy("_file", "_end").agg((F.sum(F.length("value")) + F.count("value")).alias("n")).agg(F.max("n")).first()[0]
    if longest is not None and longest > most:
        raise ValueError(f"a record of {longest} characters; a quote may not end")
    place = F.struct("_block", "_seq", "value")
    joined = parts.repartition(tasks, "_file", "_end").groupBy("_file", "_end").agg(F.array_sort(F.collect_list(place)).alias("_parts"))
    first = F.col("_parts")[0]
    several = joined.select(
        "_file", first["_block"].alias("_block"), first["_seq"].alias("_seq"), F.array_join(F.col("_parts")["value"], "\n").alias("value")
    )
    return single.unionByName(several)
