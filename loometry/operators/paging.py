"""Pages of results."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loometry import fixed
from loometry.operators.scans import with_value_chunk


@dataclass
class Page:
    data: DataFrame
    count: int
    page: int
    page_size: int
    total_pages: int


def page_rows(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """Rows ``offset .. offset + limit`` of the ordered result (a top-k per
    task, no full sort while ``offset + limit`` is small)."""
    check_limit(limit)
    return df.orderBy(*order).offset(offset).limit(limit)


def check_limit(limit: int) -> None:
    """A page holds 1 to MAX_PAGE_SIZE rows; anything else is refused, not cut."""
    if not 1 <= limit <= fixed.MAX_PAGE_SIZE:
        raise ValueError(f"a page holds 1 to {fixed.MAX_PAGE_SIZE} rows, not {limit}")


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> Page:
    """A page with its totals. The count runs on the unordered rows."""
    check_limit(limit)
    total = df.count()
    return Page(
        data=page_rows(df, order, limit, offset),
        count=total,
        page=offset // limit + 1,
        page_size=limit,
        total_pages=-(-total // limit),
    )


def deep_page_rows(
    df: DataFrame, along: Column, order: Sequence[Column], limit: int, offset: int, *, deep: int, chunks: int = 1024
) -> DataFrame:
    """The same rows as ``page_rows``, for offsets too large for a top-k per task.

    ``along`` is the numeric value that ``order`` sorts by first, descending
    with nulls first. Rows are counted per quantile chunk of it (at most
    ``chunks`` numbers reach the driver), chunks before the page are skipped
    whole, and only the chunks of the page are ordered. Repeated while that
    still leaves a deep offset and the chunks still divide.
    """
    check_limit(limit)
    while offset + limit > deep:
        bucketed = with_value_chunk(df.withColumn("_along", along), "_along", chunks=chunks).withColumn(
            "_place", F.when(F.col("_along").isNull(), F.lit(float("inf"))).otherwise(F.col("_bucket"))
        )
        counts = sorted(
            ((r["_place"], r["n"]) for r in bucketed.groupBy("_place").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True
        )
        before, wanted, skipped = 0, [], 0
        for place, n in counts:
            if before + n <= offset:
                skipped += n
            elif before < offset + limit:
                wanted.append(place)
            before += n
        rest = bucketed.filter(F.col("_place").isin(wanted)).drop("_along", "_bucket", "_place") if wanted else df.limit(0)
        if not skipped and len(wanted) == len(counts):
            break  # one chunk of equal values: nothing left to divide
        df, offset = rest, offset - skipped
    return df.orderBy(*order).offset(offset).limit(limit)
