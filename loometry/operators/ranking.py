"""Rankings, running sums, quantiles and first rows that do not send a whole
key to one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loometry.operators.scans import chunked, null_safe_join, one_row, scan


def ranked(
    df: DataFrame, keys: Sequence[str], value: str, tie: str, *, tiles: int | None = None,
) -> DataFrame:
    """row_number, rank, dense_rank, previous and next value, running sum (and
    ntile) by ``value`` then ``tie`` within each key, all ascending.

    Nulls are a value of their own and come first; null keys form a group.
    ``rank`` and ``dense_rank`` come from the distinct values, which are counted
    before they are ordered.
    """
    placed, chunk = chunked(df, keys, [value, tie])
    rows = scan(
        placed, keys, [value, tie], chunk, number="row_number", sums={"running_sum": F.col(value)},
        before={"previous": F.col(value)}, after={"following": F.col(value)},
    )
    # Nulls come first, so a sum has begun exactly where the value is not null.
    rows = rows.drop("_bucket").withColumn("running_sum", F.when(F.col(value).isNotNull(), F.col("running_sum")))
    values, part = chunked(rows.groupBy(*keys, value).agg(F.min("row_number").alias("rank")), keys, [value])
    places = scan(values, keys, [value], part, number="dense_rank").drop("_bucket")
    out = null_safe_join(rows, places, [*keys, value])
    if tiles:
        totals = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_all"))
        out = null_safe_join(out, totals, list(keys)).withColumn("ntile", ntile(F.col("row_number"), F.col("_all"), tiles)).drop("_all")
    return out


def ntile(number: Column, total: Column, tiles: int) -> Column:
    """Tile of a row: the first ``total mod tiles`` tiles hold one row more."""
    size = F.floor(total / tiles)
    extra = total % tiles
    border = extra * (size + 1)
    return F.when(number <= border, F.floor((number - 1) / (size + 1))).otherwise(
        extra + F.floor((number - 1 - border) / F.greatest(size, F.lit(1)))
    ) + 1


def exact_quantile(
    df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float]
) -> DataFrame:
    """Continuous quantiles (linear interpolation), exact.

    Null values do not count; null keys form a group. Values are counted first, so a key's rows never meet in one place; the
    counts are then added up along the values. One output row per key with a
    column ``q_<share>`` per share.
    """
    some = df.filter(F.col(value).isNotNull())
    counts = some.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    bucketed, chunk = chunked(counts, keys, [value])
    upto = scan(bucketed, keys, [value], chunk, sums={"_upto": F.col("_c")})
    if keys:
        placed = null_safe_join(upto, counts.groupBy(*keys).agg(F.sum("_c").alias("_n")), list(keys))
    else:
        placed = upto.withColumn("_n", counts.agg(F.sum("_c")).scalar())
    first, last = F.col("_upto") - F.col("_c"), F.col("_upto") - 1  # 0-based ranks of the value

    def pick(rank: Column) -> Column:
        return F.max(F.when((first <= rank) & (rank <= last), F.col(value)))

    out = []
    for share in shares:
        at = (F.col("_n") - 1) * F.lit(float(share))
        low, high = pick(F.floor(at)), pick(F.ceil(at))
        part = F.max(at - F.floor(at))
        out.append((low + (high - low) * part).alias(f"q_{str(share).replace('.', '_')}"))
    return placed.groupBy(*keys).agg(*out)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """DISTINCT ON, or QUALIFY row_number() = 1."""
    return one_row(df, keys, order)
