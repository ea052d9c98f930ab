"""Links between media, runs and their steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loometry.functions.media import not_deleted
from loometry.functions.review import duration_seconds, final_run_status
from loometry import fixed
from loometry.functions.text import snake_case
from loometry.operators.timeline import asof_last
from loometry.session import cut_lineage


# --- media links --------------------------------------------------------------

def enrich_asset_links(items: DataFrame, source_assets: DataFrame) -> DataFrame:
    """Replace ``source_assets`` (array of asset_id, role) by the linked assets;
    links to missing or deleted assets are dropped."""
    links = items.select("id", F.posexplode("source_assets").alias("pos", "link")).select(
        "id", "pos", "link.asset_id", "link.role"
    )
    assets = source_assets.filter(not_deleted()).select(
        F.col("id").alias("_aid"), "gcs_uri", "mime_type", "thumbnail_gcs_uri"
    )
    entry = F.struct("pos", "asset_id", "role", "gcs_uri", "mime_type", "thumbnail_gcs_uri")
    # Regrouped per item: no longer than the array it came from.
    lists = (
        links.join(assets, F.col("asset_id") == F.col("_aid"))
        .groupBy("id").agg(F.sort_array(F.collect_list(entry)).alias("_links"))
    )
    none = F.array().cast("array<struct<asset_id:bigint,role:string,gcs_uri:string,mime_type:string,thumbnail_gcs_uri:string>>")
    kept = F.transform("_links", lambda e: F.struct(*[
        e[n].alias(n) for n in ("asset_id", "role", "gcs_uri", "mime_type", "thumbnail_gcs_uri")
    ]))
    return items.drop("source_assets").join(lists, "id", "left").withColumn(
        "source_assets", F.coalesce(kept, none)
    ).drop("_links")


def parent_links(items: DataFrame, parents: DataFrame) -> DataFrame:
    """One row per input item: the file of the parent at ``media_index``. Links
    to missing parents or positions are dropped."""
    links = items.select("id", F.explode("source_media_items").alias("link")).select(
        "id", F.col("link.media_item_id").alias("parent_id"), "link.media_index", "link.role"
    )
    known = parents.filter(not_deleted()).select(
        F.col("id").alias("_pid"), "gcs_uris", "thumbnail_uris", "mime_type"
    )
    index = F.col("media_index")
    inside = (index >= 0) & (index < F.array_size("gcs_uris"))
    return links.join(known, F.col("parent_id") == F.col("_pid")).filter(inside).select(
        "id", "parent_id", "media_index", F.get("gcs_uris", index).alias("gcs_uri"),
        F.get("thumbnail_uris", index).alias("thumbnail_uri"), "mime_type", "role",
    )


# --- runs ------------------------------------------------------------------------

def run_durations(runs: DataFrame, now: Column) -> DataFrame:
    return runs.withColumn("duration", duration_seconds(F.col("started_at"), F.col("ended_at"), now))


def sync_run_status(runs: DataFrame, now: Column) -> DataFrame:
    """Runs take the final state of their executor; the end is its end, or now."""
    status = final_run_status(F.col("status"), F.col("state"))
    done = (F.col("status") == "running") & (status != "running")
    return runs.withColumn(
        "completed_at", F.when(done, F.coalesce("ended_at", now))
    ).withColumn("status", status)


def new_runs(executions: DataFrame, workflows: DataFrame, now: Column) -> DataFrame:
    """Run rows for started executions, with the workflow as it is now."""
    snapshot = F.to_json(F.struct(*[c for c in workflows.columns if c not in ("created_at", "updated_at")]))
    flows = workflows.select(F.col("id").alias("workflow_id"), snapshot.alias("workflow_snapshot"))
    return executions.join(flows, "workflow_id").select(
        "id", "workflow_id", "user_id", "workspace_id", F.lit("running").alias("status"),
        now.alias("started_at"), F.lit(None).cast("timestamp").alias("completed_at"), "workflow_snapshot",
    )


def resolve_inputs(inputs: DataFrame, outputs: DataFrame, entries: DataFrame) -> DataFrame:
    """Value of every input item: its literal, or the output of the step it
    names as it stood before this entry ran. A step that ran more than once
    counts with its latest earlier run; unknown references give null.

    inputs   run_id, entry_pos, step_id, input, item_pos, ref_step, ref_output, literal
    outputs  run_id, entry_pos, step_id, output, value
    entries  run_id, entry_pos, step_id
    """
    refs = inputs.filter(F.col("ref_step").isNotNull())
    ran = entries.select("run_id", F.col("step_id").alias("ref_step"), F.col("entry_pos").alias("at"))
    found = asof_last(
        refs, ran, keys=["run_id", "ref_step"], left_time="entry_pos", right_time="at",
        value=F.col("at"), name="source_pos", strict=True,
    )
    values = outputs.select(
        "run_id", F.col("entry_pos").alias("source_pos"), F.col("output").alias("ref_output"),
        F.col("value").alias("value"),
    )
    resolved = found.join(values, ["run_id", "source_pos", "ref_output"], "left")
    literal = inputs.filter(F.col("ref_step").isNull()).withColumn("value", F.col("literal"))
    columns = ["run_id", "entry_pos", "step_id", "input", "item_pos", "value"]
    return resolved.select(*columns).unionByName(literal.select(*columns))


def media_of_runs(values: DataFrame, outputs: DataFrame) -> DataFrame:
    """Distinct media and asset ids that the media fields of a run mention.

    ``values`` (run_id, field_type, value) holds JSON in fields of every type; only those
    of type image, audio and video are looked at, so that a seed is no media id. In
    them a number is a media id; an object may hold an asset id, a media item, or a
    reference to a step's output, which is followed; lists are searched to any depth. ``outputs`` (run_id, step_id,
    entry_pos, output, value) gives the step results; the last run of a step
    counts.
    """
    latest = outputs.groupBy("run_id", "step_id").agg(F.max("entry_pos").alias("entry_pos"))
    final = outputs.join(latest, ["run_id", "step_id", "entry_pos"]).select(
        "run_id", F.col("step_id").alias("ref_step"), F.col("output").alias("ref_output"),
        F.col("value").alias("_next"),
    )
    final = cut_lineage(final, "results")
    media = values.filter(F.col("field_type").isin(fixed.MEDIA_FIELDS))
    todo, found, followed = media.select("run_id", "value").distinct(), None, None
    while True:
        # Parsed once and written: ids, list items and references are then read
        # from columns, and a lost executor does not repeat earlier rounds.
        step = cut_lineage(_mentions(todo), "mentions")
        if found is not None and step.isEmpty():
            return found.distinct()
        ids = step.filter(F.col("id").isNotNull()).select("run_id", "kind", "id")
        found = ids if found is None else found.unionByName(ids)
        asks = step.filter(F.col("ref_step").isNotNull()).select("run_id", "ref_step", "ref_output").distinct()
        if followed is not None:
            asks = asks.join(followed, ["run_id", "ref_step", "ref_output"], "left_anti")
        asks = cut_lineage(asks, "asked")
        todo = step.select("run_id", F.explode("items").alias("value")).unionByName(
            asks.join(final, ["run_id", "ref_step", "ref_output"]).select("run_id", F.col("_next").alias("value"))
        )
        followed = asks if followed is None else followed.unionByName(asks)


def _mentions(values: DataFrame) -> DataFrame:
    """What each JSON value is: an id (with its kind), a reference, or a list."""
    raw = F.trim("value")
    fields = F.from_json(
        F.when(raw.startswith("{"), raw),
        "step string, output string, sourceAssetId string, source_asset_id string, "
        "sourceMediaItem struct<mediaItemId:string>",
    )
    rows = values.select("run_id", raw.alias("raw"), fields.alias("o"))
    set_ = lambda c: F.nullif(F.nullif(c, F.lit("")), F.lit("0"))
    is_ref = (F.coalesce("o.step", F.lit("")) != "") & (F.coalesce("o.output", F.lit("")) != "")
    number = F.when(F.col("raw").rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"), F.col("raw"))
    asset = set_(F.coalesce("o.sourceAssetId", "o.source_asset_id"))
    item = set_(F.col("o.sourceMediaItem.mediaItemId"))
    # Through a variant, so that list items keep their JSON type.
    listed = F.when(F.col("raw").startswith("["), F.try_parse_json("raw")).cast("array<variant>")
    return rows.select(
        "run_id",
        F.when(~F.coalesce(is_ref, F.lit(False)), F.coalesce(asset, item, set_(number))).alias("id"),
        F.when(asset.isNotNull(), "asset").otherwise("media").alias("kind"),
        F.when(is_ref, F.col("o.step")).alias("ref_step"), F.when(is_ref, F.col("o.output")).alias("ref_output"),
        F.transform(listed, lambda x: F.to_json(x)).alias("items"),
    )


# --- batch runs --------------------------------------------------------------------

def map_headers(headers: Sequence[str], expected: Sequence[str]) -> dict[str, str]:
    """Input per header: the one that its snake-case form names, else the one of its
    very name. Headers that name no input are left out; an input that no header names
    is an error."""
    inputs = set(expected)
    named = {header: [form for form in (snake_case(header), header) if form in inputs] for header in headers}
    mapping = {header: forms[0] for header, forms in named.items() if forms}
    unmet = inputs.difference(mapping.values())
    if unmet:
        raise ValueError(fixed.MISSING_COLUMNS + ", ".join(name for name in expected if name in unmet))
    return mapping


def batch_rows(rows: DataFrame, expected: Sequence[str], workspace_id: int, index: str = "row_idx") -> DataFrame:
    """(row_index, args) per sheet row; a later column of the same input wins."""
    mapping = map_headers([c for c in rows.columns if c != index], expected)
    source = {name: header for header, name in mapping.items()}
    pairs = [F.lit("workspace_id"), F.lit(str(workspace_id))]
    for name, header in source.items():
        pairs += [F.lit(name), F.coalesce(F.col(f"`{header}`"), F.lit(""))]
    return rows.select(F.col(index).alias("row_index"), F.create_map(*pairs).alias("args"))


def rewrite_batch_args(rows: DataFrame, source_assets: DataFrame) -> DataFrame:
    """Replace ``gs://`` arguments by their assets.

    ``rows`` (row_index, args map<string,string>): a value is one uri or a JSON
    list of uris. Every row yields a result: SUCCESS with rewritten args, or
    FAILED with the reason.
    """
    values = rows.select(
        "row_index", F.col("args")["workspace_id"].alias("workspace"), F.explode("args").alias("key", "value")
    )
    is_list = F.col("value").startswith('["gs://')
    uris = F.when(F.col("value").startswith("gs://"), F.array("value")).when(
        is_list, F.from_json("value", "array<string>")
    )
    wanted = values.select("row_index", "workspace", "key", is_list.alias("is_list"), F.posexplode(uris).alias("pos", "uri"))
    assets = source_assets.filter(not_deleted()).groupBy(F.col("gcs_uri").alias("uri")).agg(F.min("id").alias("asset_id"))
    entry = F.struct(F.col("asset_id").alias("sourceAssetId"), F.col("uri").alias("previewUrl"))
    error = F.when(F.coalesce("workspace", F.lit("")) == "", "No workspace_id provided for GCS ingestion.").when(
        F.col("asset_id").isNull(), F.concat(F.lit("not found: "), F.col("uri"))
    )
    per_key = (
        wanted.join(assets, "uri", "left")
        .groupBy("row_index", "key", "is_list")
        .agg(
            F.array_sort(F.collect_list(F.struct("pos", entry.alias("e")))).alias("items"),
            F.min(F.when(error.isNotNull(), F.struct(F.col("pos"), error.alias("why"))))["why"].alias("why"),
        )
        .select(
            "row_index", "key", "why",
            F.when(F.col("is_list"), F.to_json(F.transform("items", lambda x: x["e"])))
            .otherwise(F.to_json(F.get("items", F.lit(0))["e"])).alias("new"),
        )
    )
    # Arguments per row: at most as many as the row's own map.
    per_row = per_key.groupBy("row_index").agg(
        F.map_from_entries(F.collect_list(F.struct("key", "new"))).alias("new_args"),
        F.min(F.when(F.col("why").isNotNull(), F.struct("key", "why"))).alias("fault"),
    )
    new_args = F.map_concat(
        F.map_filter("args", lambda k, v: ~F.coalesce(F.map_contains_key("new_args", k), F.lit(False))),
        F.coalesce("new_args", F.create_map().cast("map<string,string>")),
    )
    failed = F.col("fault").isNotNull()
    return rows.join(per_row, "row_index", "left").select(
        "row_index",
        F.when(failed, "FAILED").otherwise("SUCCESS").alias("status"),
        F.when(failed, F.concat(F.lit("Invalid GCS URI in '"), F.col("fault.key"), F.lit("': "), F.col("fault.why"))).alias("error"),
        F.when(~failed, new_args).alias("args"),
    )


def batch_outcome(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count_if(F.col("status") == "SUCCESS").alias("succeeded"),
        F.count_if(F.col("status") == "FAILED").alias("failed"),
    )
