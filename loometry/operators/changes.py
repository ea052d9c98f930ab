"""Table changes. Each takes the current table and gives the next one; write it
with ``sources.tables.write_table``. ``now`` is always a parameter.

Key sets come as DataFrames, so they may be as large as the table itself. They
are reduced to distinct keys before they meet it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loometry import fixed
from loometry.operators.scans import chunked, consecutive_ids, one_row, scan
from loometry.session import cut_lineage


def _marked(table: DataFrame, keys: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The table with ``_hit`` telling whether the row's key is listed."""
    listed = keys.select(*columns).distinct().withColumn("_hit", F.lit(True))
    return table.join(listed, list(columns), "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))


def soft_delete(table: DataFrame, keys: DataFrame, now: Column, by: int | None = None, key: str = "id") -> DataFrame:
    """Mark listed rows that are not deleted yet."""
    hit = F.col("_hit") & F.col("deleted_at").isNull()
    changes = {"deleted_at": F.when(hit, now).otherwise(F.col("deleted_at"))}
    if by is not None and "deleted_by" in table.columns:
        changes["deleted_by"] = F.when(hit, F.lit(by)).otherwise(F.col("deleted_by")).cast("long")
    return _marked(table, keys, [key]).withColumns(changes).select(*table.columns)


def restore(table: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    hit = F.col("_hit")
    changes = {c: F.when(~hit, F.col(c)) for c in ("deleted_at", "deleted_by") if c in table.columns}
    return _marked(table, keys, [key]).withColumns(changes).select(*table.columns)


def hard_delete(table: DataFrame, keys: DataFrame, columns: Sequence[str] = ("id",)) -> DataFrame:
    return table.join(keys.select(*columns).distinct(), list(columns), "left_anti").select(*table.columns)


def partial_update(table: DataFrame, updates: DataFrame, now: Column, key: str = "id") -> DataFrame:
    """Set the columns that ``updates`` gives a value for; null leaves the old
    value. Changed rows get a new ``updated_at``. Keys in ``updates`` are unique."""
    fields = [c for c in updates.columns if c != key]
    new = updates.select(F.col(key), F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in fields])
    changes = {c: F.coalesce(f"_new_{c}", c) for c in fields}
    if "updated_at" in table.columns:
        changes["updated_at"] = F.when(F.col("_hit"), now).otherwise(F.col("updated_at"))
    return table.join(new, key, "left").withColumns(changes).select(*table.columns)


def is_stuck(now: Column) -> Column:
    return (F.col("status") == "processing") & (F.col("created_at") < now - F.expr(f"interval {fixed.STUCK_AFTER}"))


def stop_stuck_jobs(media_items: DataFrame, now: Column) -> DataFrame:
    """Jobs still processing an hour after they began are stopped."""
    return media_items.withColumn("status", F.when(is_stuck(now), "stopped").otherwise(F.col("status")))


def new_rows(table: DataFrame, rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows whose key the table lacks, the first of each key."""
    return one_row(rows, list(keys), list(order)).join(table.select(*keys), list(keys), "left_anti").select(*rows.columns)


def insert_ignore(table: DataFrame, rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Add rows with new keys; stored rows stay as they are."""
    return table.unionByName(new_rows(table, rows, keys, order))


def seed_missing(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Seed rows that are not there yet."""
    rest = [F.col(c) for c in rows.columns if c != key]
    return insert_ignore(table, rows, [key], rest)


def replace_by_key(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Delete the rows of the given keys, then insert."""
    return hard_delete(table, rows, keys).unionByName(rows)


def upsert(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Insert rows with new keys; for known keys set the given columns. Columns
    that ``rows`` lacks keep their value. Keys are unique on both sides."""
    fields = [c for c in rows.columns if c not in keys]
    new = rows.select(*keys, F.lit(True).alias("_new"), *[F.col(c).alias(f"_new_{c}") for c in fields])
    both = table.join(new, list(keys), "full_outer")
    values = {c: F.when(F.col("_new"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in fields}
    return both.withColumns(values).select(*table.columns)


def max_id(table: DataFrame, key: str = "id") -> int:
    """Largest id (one number; Parquet statistics answer it)."""
    return table.agg(F.max(key)).first()[0] or 0


def tag_colour(count_before: Column) -> Column:
    palette = F.array(*[F.lit(c) for c in fixed.TAG_COLORS])
    return F.get(palette, (count_before % len(fixed.TAG_COLORS)).cast("int"))


def create_tags(
    tags: DataFrame, wanted: DataFrame, user_id: int, now: Column
) -> DataFrame:
    """Rows for tag names a workspace lacks.

    ``wanted`` (workspace_id, name, pos) gives names in a unique order ``pos``.
    The colour follows from the number of tags the workspace has by then.
    """
    fresh = new_rows(tags, wanted, ["workspace_id", "name"], [F.col("pos")])
    have = tags.groupBy("workspace_id").agg(F.count(F.lit(1)).alias("_have"))
    placed, chunk = chunked(fresh, ["workspace_id"], ["pos"])
    numbered = scan(placed, ["workspace_id"], ["pos"], chunk, number="_nth")
    numbered = numbered.join(have, "workspace_id", "left")
    before = F.coalesce("_have", F.lit(0)) + F.col("_nth") - 1
    ready = numbered.select(
        "pos", "workspace_id", "name", tag_colour(before).alias("color"),
        F.lit(user_id).cast("long").alias("user_id"), now.alias("updated_at"),
    )
    return consecutive_ids(ready, "pos", max_id(tags) + 1).drop("pos")


def assign_tags(
    tags: DataFrame, links: DataFrame, items: DataFrame, wanted: DataFrame, user_id: int, now: Column,
    item_column: str = "media_item_id",
) -> tuple[DataFrame, DataFrame]:
    """Give every listed item exactly the wanted tags, creating missing tags.

    ``items`` (item_column, workspace_id) and ``wanted`` (workspace_id, name,
    pos). Returns the next tag table and the next link table. Tags that were
    assigned count as just used.
    """
    # Written once: both returned tables use the new ids, and assigning them is
    # not to be repeated.
    added = cut_lineage(create_tags(tags, wanted, user_id, now), "tags")
    every = tags.unionByName(added.select(*tags.columns))
    # A name that exists more than once in a workspace resolves to its oldest tag.
    ids = (
        every.join(wanted.select("workspace_id", "name").distinct(), ["workspace_id", "name"], "left_semi")
        .groupBy("workspace_id", "name").agg(F.min("id").alias("tag_id"))
    )
    pairs = items.select(item_column, "workspace_id").distinct().join(
        ids.select("workspace_id", "tag_id"), "workspace_id"
    ).select(item_column, "tag_id")
    next_links = hard_delete(links, items, [item_column]).unionByName(pairs.select(*links.columns))
    used = ids.select(F.col("tag_id").alias("id"))
    next_tags = _marked(every, used, ["id"]).withColumn(
        "updated_at", F.when(F.col("_hit"), now).otherwise(F.col("updated_at"))
    ).select(*tags.columns)
    return next_tags, next_links


def copies(
    items: DataFrame, keys: DataFrame, first_id: int, workspace_id: int, user_id: int, now: Column,
    user_email: str | None = None, key: str = "id",
) -> DataFrame:
    """Copies of the listed rows for a workspace: new ids, new owner, fresh
    timestamps, not deleted."""
    listed = keys.select(key).distinct()
    picked = items.filter(F.col("deleted_at").isNull()).join(listed, key, "left_semi").withColumnRenamed(key, "_old")
    numbered = consecutive_ids(picked, "_old", first_id, name=key)
    overrides = {
        "workspace_id": F.lit(workspace_id).cast("long"), "user_id": F.lit(user_id).cast("long"),
        "user_email": F.lit(user_email), "created_at": now, "updated_at": now,
        "deleted_at": F.lit(None).cast("timestamp"), "deleted_by": F.lit(None).cast("long"),
    }
    changed = {c: v for c, v in overrides.items() if c in items.columns}
    return numbered.withColumns(changed).select(*items.columns)


def first_uploads(uploads: DataFrame, order: Sequence[str] = ("created_at", "id")) -> DataFrame:
    """The first upload of each (user, content hash)."""
    return one_row(uploads, ["user_id", "file_hash"], [F.col(c) for c in order])


def resolve_uploads(uploads: DataFrame, order: Sequence[str] = ("created_at", "id")) -> DataFrame:
    """Every upload with the id of the row that stands for it: the first of its
    user and content. One row per distinct content meets the uploads. An upload
    without a user or a hash stands for itself."""
    known = uploads.filter(F.col("user_id").isNotNull() & F.col("file_hash").isNotNull())
    first = known.groupBy("user_id", "file_hash").agg(F.min_by("id", F.struct(*order)).alias("kept_id"))
    return uploads.join(first, ["user_id", "file_hash"], "left").withColumn("kept_id", F.coalesce("kept_id", "id"))


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return one_row(df, list(keys), list(order), latest=True)


def merged_palette(partials: DataFrame, keys: Sequence[str], column: str = "color_palette") -> DataFrame:
    """Distinct colours of partial results, upper case, one row per colour in
    order of name. Kept as rows: nothing bounds how many a key has."""
    return (
        partials.select(*keys, F.explode(column).alias("c"))
        .filter(F.col("c") != "")
        .select(*keys, F.upper("c").alias("color"))
        .distinct()
    )
