"""Ordered computations that survive a hot key.

A plain window sends every row of a key to one task. ``scan`` splits each key
into chunks of consecutive rows, runs the window inside a chunk, and carries
one summary row per chunk forward. A key with a third of all rows is then
spread over as many tasks as it has chunks; only the summaries, smaller by the
chunk size, are ordered per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loometry.session import cut_lineage

CHUNK_ROWS = 1 << 20


def chunk_of(index: str, rows: int = CHUNK_ROWS) -> Column:
    """Chunk number of an integer position."""
    return F.expr(f"cast(`{index}` as bigint) div {rows}")


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    *,
    number: str | None = None,
    counts: dict[str, Column] | None = None,
    sums: dict[str, Column] | None = None,
    last: dict[str, Column] | None = None,
    before: dict[str, Column] | None = None,
    after: dict[str, Column] | None = None,
    parts: int | None = None,
) -> DataFrame:
    """Add ordered columns to ``df``.

    ``chunk`` must not decrease along ``order`` within a key, and ``order`` must
    be unique within a key where ``number``, ``before`` or ``after`` is asked.

    number  1-based position within the key
    counts  running count of rows where the condition holds, this row included
    sums    running sum, this row included
    last    latest non-null value, this row included
    before  value in the previous row
    after   value in the next row

    ``parts`` fixes the number of partitions the chunks are dealt to; by default Spark
    puts small ones together by their compressed bytes.
    """
    counts, sums, last = counts or {}, sums or {}, last or {}
    before, after = before or {}, after or {}
    keys, order = list(keys), list(order)
    columns = df.columns
    # One struct names key and chunk everywhere below. As a struct it is never
    # null, so null keys group and join like any other; and since no plain key
    # column is grouped on, Spark can not settle for an existing partitioning by
    # the key alone, which would bring a hot key back into one task.
    df = df.withColumn("_g", F.struct(*keys, chunk.alias("_chunk")))
    # A single order column and plain values keep the totals in the hash
    # aggregation; structs would make Spark sort for them.
    position = F.col(order[0]) if len(order) == 1 else F.struct(*order)

    # Totals of each chunk: partial aggregation, so a hot chunk is combined
    # before it is shuffled.
    totals = {}
    if number:
        totals["_n"] = F.count(F.lit(1))
    for name, cond in counts.items():
        totals[f"_c_{name}"] = F.count_if(cond)
    for name, value in sums.items():
        totals[f"_s_{name}"] = F.sum(value)
    for name, value in last.items():
        totals[f"_l_{name}"] = F.max_by(value, F.when(value.isNotNull(), position))
    for name, value in before.items():
        totals[f"_b_{name}"] = F.max_by(value, position)
    for name, value in after.items():
        totals[f"_a_{name}"] = F.min_by(value, position)
    summary = df.groupBy("_g").agg(*[c.alias(n) for n, c in totals.items()]).select("_g", "_g.*", *totals)

    ordered = Window.partitionBy(*keys).orderBy("_chunk")
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    carried = []
    for name in totals:
        kind = name[:3]
        if kind in ("_n", "_c_", "_s_"):
            carried.append(F.sum(name).over(earlier).alias(name))
        elif kind == "_l_":
            carried.append(F.last(name, ignorenulls=True).over(earlier).alias(name))
        elif kind == "_b_":
            carried.append(F.lag(name).over(ordered).alias(name))
        else:
            carried.append(F.lead(name).over(ordered).alias(name))
    # Keys of a single chunk, the usual case, have nothing to carry: with them
    # gone the carry is empty or small and joins without a shuffle.
    neighbours = F.lag(F.lit(True)).over(ordered).isNotNull()
    if after:
        neighbours = neighbours | F.lead(F.lit(True)).over(ordered).isNotNull()
    carry = summary.select(F.col("_g").alias("_h"), *carried, neighbours.alias("_near")).filter("_near").drop("_near")

    # The one shuffle of the rows: window and join both use it.
    df = df.repartition(parts, "_g") if parts else df.repartition("_g")
    inside = Window.partitionBy("_g").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = {}
    if number:
        local["_ln"] = F.row_number().over(inside)
    for name, cond in counts.items():
        local[f"_lc_{name}"] = F.count_if(cond).over(upto)
    for name, value in sums.items():
        local[f"_ls_{name}"] = F.sum(value).over(upto)
    for name, value in last.items():
        local[f"_ll_{name}"] = F.last(value, ignorenulls=True).over(upto)
    # Whether a chunk has a row before (after) this one, as its value may be null.
    if before:
        local["_lb"] = F.lag(F.lit(True)).over(inside)
    if after:
        local["_la"] = F.lead(F.lit(True)).over(inside)
    for name, value in before.items():
        local[f"_lb_{name}"] = F.lag(value).over(inside)
    for name, value in after.items():
        local[f"_la_{name}"] = F.lead(value).over(inside)
    rows = df.select("*", *[c.alias(n) for n, c in local.items()])

    joined = rows.join(carry, F.col("_g") == F.col("_h"), "left")

    out = [F.col(c) for c in columns]
    if number:
        out.append((F.coalesce("_n", F.lit(0)) + F.col("_ln")).alias(number))
    for name in counts:
        out.append((F.coalesce(f"_c_{name}", F.lit(0)) + F.col(f"_lc_{name}")).alias(name))
    for name in sums:
        out.append((F.coalesce(f"_s_{name}", F.lit(0)) + F.coalesce(f"_ls_{name}", F.lit(0))).alias(name))
    for name in last:
        out.append(F.coalesce(f"_ll_{name}", f"_l_{name}").alias(name))
    for name in before:
        out.append(F.when(F.col("_lb"), F.col(f"_lb_{name}")).otherwise(F.col(f"_b_{name}")).alias(name))
    for name in after:
        out.append(F.when(F.col("_la"), F.col(f"_la_{name}")).otherwise(F.col(f"_a_{name}")).alias(name))
    return joined.select(*out)


def first_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, number: str = "_rn"
) -> DataFrame:
    """The first ``n`` rows of each key.

    Spark limits each map task to ``n`` rows per key before the shuffle (window
    group limit), so a hot key reaches one task as a few rows only.
    """
    win = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(number, F.row_number().over(win)).filter(F.col(number) <= n)
    return out.drop(number) if number == "_rn" else out


def one_row(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], latest: bool = False
) -> DataFrame:
    """The first (or latest) whole row of each key, by partial aggregation."""
    pick = F.max_by if latest else F.min_by
    rest = [c for c in df.columns if c not in keys]
    best = pick(F.struct(*rest), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]))
    return df.groupBy(*keys).agg(best.alias("_row")).select(*keys, "_row.*").select(*df.columns)


def with_value_chunk(df: DataFrame, value: str, chunks: int, sample: DataFrame | None = None) -> DataFrame:
    """Add ``_bucket``, a chunk number along a numeric column.

    The borders are approximate quantiles (of ``sample``, by default of ``df``
    itself), so chunks hold about as many rows each, whatever the values look
    like; a key with a third of the rows spans about a third of them. Borders
    are read once and are constants of the plan from then on. Equal values share
    a chunk.
    """
    shares = [i / chunks for i in range(1, chunks)]
    found = (df if sample is None else sample).agg(
        F.percentile_approx(F.col(value).cast("double"), shares, 10 * chunks)
    ).first()[0]
    borders = sorted({b for b in found or [] if b == b and abs(b) != float("inf")})
    bucketizer = Bucketizer(
        splits=[float("-inf"), *(borders or [0.0]), float("inf")], inputCol="_value", outputCol="_bucket",
        handleInvalid="keep",
    )
    return bucketizer.transform(df.withColumn("_value", F.col(value).cast("double"))).drop("_value")


def chunked(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> tuple[DataFrame, Column]:
    """``df`` with its chunk column for ``scan``: the rows are range-partitioned by
    ``keys`` and ``order``, and a chunk is what fell into one partition.

    One path for any size and any orderable type; a key with a third of all rows, or
    a value that most rows of a key share, spans many partitions, as the whole order
    takes part. The placed rows are written once to the shared folder: every later
    step then sees the same chunks.
    """
    placed = df.repartitionByRange(*keys, *order).withColumn("_bucket", F.spark_partition_id())
    return cut_lineage(placed, "chunks"), F.col("_bucket")


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys``, null keys being equal to each other; ``right`` has each key once."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    if not keys:
        return left.join(renamed)
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def consecutive_ids(df: DataFrame, order: str, start: int, name: str = "id") -> DataFrame:
    """New ids ``start, start+1, ...`` in the order of a unique column."""
    # Only the column is sorted and numbered; whole rows meet their number by a join.
    keys, chunk = chunked(df.select(F.col(order).alias("_key")), [], ["_key"])
    numbered = scan(keys, [], ["_key"], chunk, number="_number").select("_key", "_number")
    joined = df.join(numbered, F.col(order).eqNullSafe(F.col("_key")))
    return joined.withColumn(name, F.lit(start) + F.col("_number") - 1).drop("_number", "_key")
