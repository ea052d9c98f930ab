"""Rendezvous sharding of stable record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts per shard within which rows are numbered. A part is numbered by one
#: task; a shard never is.
PARTS = 1024


def shard_score(key: Column, shard: int, weight: float = 1.0) -> Column:
    """Weighted rendezvous score: ln(u) / weight with u uniform in (0, 1) from key and shard."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11)
    uniform = (bits.cast("double") + F.lit(0.5)) * F.lit(2.0**-53)
    return F.log(uniform) / F.lit(float(weight))


def best_shard(key: Column, weights: Sequence[float]) -> Column:
    """Struct (score, shard) of the winning shard; equal scores go to the smaller shard."""
    scores = [F.struct(shard_score(key, i, w).alias("score"), F.lit(-i).alias("back")) for i, w in enumerate(weights)]
    won = F.array_max(F.array(*scores))
    return F.struct(won["score"].alias("score"), (-won["back"]).alias("shard"))


def assign(
    rows: DataFrame, key: str, shards: int, *, weights: Sequence[float] | None = None, grown_weight: float = 1.0
) -> DataFrame:
    """Add ``shard`` and ``grown_shard``, the shard once there is one shard more.

    Law `key`: both depend on the key and the shard count (and weights) alone. A
    further shard only takes rows for itself, a share of its weight. A null key
    counts as one key. Row-local: no shuffle, no state.
    """
    weights = list(weights) if weights is not None else [1.0] * shards
    if shards < 1 or len(weights) != shards or min([*weights, grown_weight]) <= 0:
        raise ValueError("one positive weight per shard is needed")
    column = F.col(f"`{key}`")
    extra = shard_score(column, shards, grown_weight)
    return (
        rows.withColumn("_best", best_shard(column, weights))
        .withColumn("shard", F.col("_best.shard"))
        .withColumn("grown_shard", F.when(extra > F.col("_best.score"), F.lit(shards)).otherwise(F.col("_best.shard")))
        .drop("_best")
    )


def number_slots(rows: DataFrame, order: Sequence[str], salt: Column) -> DataFrame:
    """Add ``slot``, gapless from 0 within ``shard``.

    Each shard is cut into parts by ``salt``; parts are counted with partial
    aggregation, laid end to end, and the rows are numbered within their part.
    """
    rows = rows.withColumn("_part", F.pmod(salt, F.lit(PARTS)).cast("int"))
    counts = rows.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("shard", "_part").orderBy(*order)
    local = rows.withColumn("_local", F.row_number().over(inside))
    return (
        local.join(offsets, ["shard", "_part"])
        .withColumn("slot", (F.col("_before") + F.col("_local") - 1).cast("long"))
        .drop("_part", "_local", "_before")
    )


def shard_documents(documents: DataFrame, shards: int = 40, *, weights: Sequence[float] | None = None) -> DataFrame:
    """Shard and slot of every document.

    ``size`` is the UTF-8 length of the text plus 16 (null: 16); the text itself
    is not shuffled. Rows with a null id share a shard; their parts are told by
    their content and place in the input, so that they spread. Repeated rows each
    keep a slot of their own. An empty table gives an empty result; columns other
    than ``doc_id`` and ``text`` are not looked at.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    placed = assign(rows, "doc_id", shards, weights=weights)
    salt = F.when(
        F.col("doc_id").isNull(), F.xxhash64("text_crc32", "size", F.monotonically_increasing_id())
    ).otherwise(F.xxhash64("doc_id", F.lit("part")))
    numbered = number_slots(placed, ["doc_id", "text_crc32", "size"], salt)
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
