"""Joins on ranges: points that lie in intervals, without a nested loop.

Intervals are sorted into levels by length: on level n cells are 2^n wide and intervals
are shorter, so that an interval meets one or two cells, however long it is. A point lies
in one cell of each level that occurs (at most 64). Both meet on level and cell by
equality and every pair is checked once. The points of a cell that holds many are dealt
into parts, and the intervals of that cell are copied to each of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loometry.operators.scans import chunked, scan

#: Points of a cell beyond which it is dealt into parts.
CELL_POINTS = 100_000


def _level(length: Column) -> Column:
    """The least n with 2^n above the length: the number of its binary digits."""
    return F.when(length == 0, 0).otherwise(F.length(F.conv(length.cast("string"), 10, 2)))


def interval_join(
    intervals: DataFrame, points: DataFrame, *, low: str, high: str, at: str, keys: Sequence[str] = (), cell_points: int = CELL_POINTS,
) -> DataFrame:
    """All pairs of an interval and a point with equal ``keys`` and ``low <= at <= high``,
    with the columns of both (names differ but for the keys).

    Bounds and points are integers; times are given as microseconds. Null bounds,
    points or keys match nothing, nor does an interval that ends before it begins.
    Repeated rows pair each on its own. Intervals whose length exceeds 2^62 are refused.
    """
    keys = list(keys)
    spans = intervals.filter((F.col(low) <= F.col(high)) & F.col(low).isNotNull()).withColumn("_span", F.col(high).cast("long") - F.col(low))
    spans = spans.withColumn("_level", F.when(F.col("_span") < 0, F.raise_error(F.lit("interval too long"))).otherwise(_level(F.col("_span")).cast("int")))
    # At most 64 numbers, whatever the tables hold.
    levels = sorted(r[0] for r in spans.select("_level").distinct().collect())
    cell = "shiftright(cast(`{}` as bigint), _level)"
    left = spans.withColumn("_cell", F.explode(F.array_distinct(F.array(F.expr(cell.format(low)), F.expr(cell.format(high)))))).drop("_span")
    known = points.filter(F.col(at).isNotNull())
    right = known.withColumn("_level", F.explode(F.array(*[F.lit(n) for n in levels]).cast("array<int>"))).withColumn("_cell", F.expr(cell.format(at)))

    place = [*keys, "_level", "_cell"]
    # Cells with many points: fewer than the points divided by the bound.
    hot = right.groupBy(*place).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > cell_points)
    hot = hot.select(*place, F.ceil(F.col("_n") / cell_points).alias("_parts"))
    left = left.join(hot, place, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1).cast("long")) - 1)))
    # Dealt by place in the input: points that are alike part as well.
    right = right.withColumn("_tie", F.monotonically_increasing_id()).join(hot, place, "left")
    right = right.withColumn("_part", F.col("_tie") % F.coalesce("_parts", F.lit(1).cast("long"))).drop("_tie")
    pairs = left.drop("_parts").join(right.drop("_parts"), [*place, "_part"])
    return pairs.filter((F.col(at) >= F.col(low)) & (F.col(at) <= F.col(high))).drop("_level", "_cell", "_part")


def counts_around(rows: DataFrame, reach: int, *, key: str, at: str, who: str, centre: Column) -> DataFrame:
    """``key, events, users``: for each key with rows where ``centre`` holds, how many rows
    of other keys lie within ``reach`` of them, and of how many distinct ``who``.

    Rows without a key or a time take no part. No pairs are formed for keys whose rows
    are alike: a row adds one to the rows met from ``reach`` before it to ``reach`` after it, and a
    who adds one wherever any of its rows does, so both are running sums along the time,
    and a centre lies in one step of them. Keys with different rows go by pairs.
    """
    known = rows.filter(F.col(key).isNotNull() & F.col(at).isNotNull())
    alike = known.groupBy(F.col(key).alias("_key"), F.col(at).cast("long").alias("_at"), F.col(who).alias("_who")).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(centre).alias("_centres")
    )
    order = ["_at", "_key"]
    placed, chunk = chunked(alike, ["_who"], order)
    # The nearest rows of the same who: where neither is near, its steps begin and end here.
    beside = scan(placed, ["_who"], order, chunk, before={"_back": F.col("_at")}, after={"_on": F.col("_at")})
    named = F.col("_who").isNotNull()

    def apart(other: str, far: int) -> Column:
        return named & (F.col(other).isNull() | (F.abs(F.col("_at") - F.col(other)) > far))

    begins, ends = apart("_back", 2 * reach).cast("long"), apart("_on", 2 * reach).cast("long")
    steps = beside.select(F.explode(F.array(
        F.struct((F.col("_at") - reach).alias("_from"), F.col("_n").alias("_rows"), begins.alias("_whos")),
        F.struct((F.col("_at") + reach + 1).alias("_from"), (-F.col("_n")).alias("_rows"), (-ends).alias("_whos")),
    )).alias("_step")).select("_step.*").groupBy("_from").agg(F.sum("_rows").alias("_rows"), F.sum("_whos").alias("_whos"))
    steps, chunk = chunked(steps, [], ["_from"])
    steps = scan(steps, [], ["_from"], chunk, sums={"_met": F.col("_rows"), "_seen": F.col("_whos")}, after={"_next": F.col("_from")})
    steps = steps.select(F.col("_from").alias("_low"), (F.col("_next") - 1).alias("_high"), "_met", "_seen").filter("_high is not null")

    lone = apart("_back", reach) & apart("_on", reach)
    centres = beside.groupBy("_key").agg(
        F.count(F.lit(1)).alias("_kinds"), F.sum("_centres").alias("_centres"), F.sum("_n").alias("_own"), F.max("_at").alias("_when"),
        F.max(lone.cast("long")).alias("_lone"),
    ).filter("_centres > 0")
    plain = interval_join(steps, centres.filter("_kinds = 1"), low="_low", high="_high", at="_when").select(
        F.col("_key").alias(key), (F.col("_centres") * (F.col("_met") - F.col("_own"))).alias("events"), (F.col("_seen") - F.col("_lone")).alias("users")
    ).filter("events > 0")

    mixed = alike.join(centres.filter("_kinds > 1").select("_key"), "_key").filter("_centres > 0")
    mixed = mixed.groupBy(F.col("_key").alias("_centre"), "_at").agg(F.sum("_centres").alias("_centres"))
    mixed = mixed.select("_centre", "_centres", (F.col("_at") - reach).alias("_low"), (F.col("_at") + reach).alias("_high"))
    pairs = interval_join(mixed, alike.select("_key", "_who", "_n", F.col("_at").alias("_when")), low="_low", high="_high", at="_when")
    paired = pairs.filter("_key <> _centre").groupBy(F.col("_centre").alias(key)).agg(
        F.sum(F.col("_centres") * F.col("_n")).alias("events"), F.countDistinct("_who").alias("users")
    )
    return plain.unionByName(paired)
