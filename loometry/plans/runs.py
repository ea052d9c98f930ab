"""Run and lineage queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loometry.functions.review import final_run_status
from loometry.operators import lineage as ln
from loometry.operators.timeline import clip_gaps
from loometry.plans.media import TS
from loometry.plans.registry import query

NOW = "2001-09-01 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


@query("date_run_duration", f"""
SELECT id, (epoch_us(coalesce(ended_at, TIMESTAMP '{NOW}')) - epoch_us(started_at)) / 1e6 AS duration FROM workflow_runs
""")
def durations(m):
    return ln.run_durations(m.workflow_runs, now()).select("id", "duration")


@query("case_run_status", """
SELECT id, CASE WHEN status = 'running' THEN CASE state WHEN 'SUCCEEDED' THEN 'completed' WHEN 'FAILED' THEN 'failed' ELSE status END ELSE status END AS status FROM workflow_runs
""")
def run_status(m):
    return m.workflow_runs.select("id", final_run_status(F.col("status"), F.col("state")).alias("status"))


@query("m11_sync_run_status", f"""
SELECT id, CASE WHEN done THEN CASE state WHEN 'SUCCEEDED' THEN 'completed' ELSE 'failed' END ELSE status END AS status,
  CASE WHEN done THEN {TS.format(f"coalesce(ended_at, TIMESTAMP '{NOW}')")} ELSE '' END AS completed_at
FROM (SELECT *, status = 'running' AND state IN ('SUCCEEDED', 'FAILED') AS done FROM workflow_runs)
""")
def m11(m):
    out = ln.sync_run_status(m.workflow_runs, now())
    return out.select("id", "status", F.coalesce(F.date_format("completed_at", "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias("completed_at"))


@query("m11_run_snapshot", """
SELECT o.o_orderkey AS id, 'wf-' || (o.o_custkey % 50) AS workflow_id, 'running' AS status,
  '{"id":"wf-' || (o.o_custkey % 50) || '","name":"flow ' || (o.o_custkey % 50) || '"}' AS workflow_snapshot
FROM orders o JOIN (SELECT DISTINCT c_custkey % 50 AS k FROM customer) c ON c.k = o.o_custkey % 50
""")
def m11b(m):
    number = (F.col("c_custkey") % 50).cast("string")
    flows = m.raw("customer").select(
        F.concat(F.lit("wf-"), number).alias("id"), F.concat(F.lit("flow "), number).alias("name")
    ).distinct()
    started = m.workflow_runs.select("id", "workflow_id", "user_id", F.lit(1).alias("workspace_id"))
    return ln.new_runs(started, flows, now()).select("id", "workflow_id", "status", "workflow_snapshot")


RESOLVED = """refs AS (SELECT i.*, (SELECT max(e.entry_pos) FROM step_entries e WHERE e.run_id = i.run_id AND e.step_id = i.ref_step AND e.entry_pos < i.entry_pos) AS source_pos
    FROM step_inputs i WHERE ref_step IS NOT NULL),
resolved AS (SELECT r.run_id, r.entry_pos, r.step_id, r.input, r.item_pos, o.value FROM refs r
    LEFT JOIN step_outputs o ON o.run_id = r.run_id AND o.entry_pos = r.source_pos AND o.output = r.ref_output
  UNION ALL SELECT run_id, entry_pos, step_id, input, item_pos, literal FROM step_inputs WHERE ref_step IS NULL)"""


@query("j13_resolve_inputs", f"WITH {RESOLVED} SELECT run_id, entry_pos, step_id, input, item_pos::BIGINT AS item_pos, coalesce(value, '') AS value FROM resolved")
def j13(m):
    out = ln.resolve_inputs(m.step_inputs, m.step_outputs, m.step_entries)
    return out.withColumn("item_pos", F.col("item_pos").cast("long")).withColumn("value", F.coalesce("value", F.lit("")))


RUN_MEDIA = """vals AS (SELECT run_id, value FROM step_outputs
    UNION SELECT i.run_id, literal FROM step_inputs i WHERE ref_step IS NULL AND entry_pos % 2 = 0
    UNION SELECT i.run_id, o.value FROM step_inputs i JOIN (SELECT * FROM step_outputs WHERE (run_id, step_id, entry_pos) IN
        (SELECT (run_id, step_id, max(entry_pos)) FROM step_outputs GROUP BY run_id, step_id)) o
      ON o.run_id = i.run_id AND o.step_id = i.ref_step AND o.output = i.ref_output),
flat AS (SELECT run_id, value FROM vals WHERE value NOT LIKE '[%'
    UNION SELECT run_id, unnest(from_json(value, '["BIGINT"]'))::VARCHAR FROM vals WHERE value LIKE '[%')"""


@query("j17_media_of_runs", f"""
WITH {RUN_MEDIA} SELECT DISTINCT run_id, CASE WHEN value LIKE '%sourceAssetId%' THEN 'asset' ELSE 'media' END AS kind, regexp_extract(value, '([0-9]+)', 1) AS id
FROM flat WHERE regexp_extract(value, '([0-9]+)', 1) <> '0'
""")
def j17(m):
    ref = F.to_json(F.struct(F.col("ref_step").alias("step"), F.col("ref_output").alias("output")))
    # A literal of every other entry is a number field: a seed, no media id.
    kind = F.when(F.col("ref_step").isNotNull() | (F.col("entry_pos") % 2 == 0), "image").otherwise("number")
    value = F.when(F.col("ref_step").isNotNull(), ref).otherwise(F.col("literal"))
    inputs = m.step_inputs.select("run_id", kind.alias("field_type"), value.alias("value"))
    outputs = m.step_outputs
    shown = outputs.select("run_id", F.col("output").alias("field_type"), "value")
    return ln.media_of_runs(inputs.unionByName(shown), outputs)


@query("w8_clip_gaps", """
SELECT clip_id, track_index, floor(gap * 1000)::BIGINT AS gap_ms FROM (SELECT clip_id, track_index,
  start_time - coalesce(lag(start_time + duration) OVER (PARTITION BY track_index ORDER BY start_us, clip_id), 0) AS gap FROM clips) WHERE gap > 0.01
""")
def w8(m):
    return clip_gaps(m.clips).select("clip_id", "track_index", F.floor(F.col("gap") * 1000).alias("gap_ms"))


def _batch(m):
    """Batch rows from the customers: asset uris, lists of uris, plain values."""
    key = F.col("c_custkey")
    uri = lambda k: F.concat(F.lit("gs://assets/"), (k % 500).cast("string"), F.lit(".jpg"))
    return m.raw("customer").select(
        key.alias("row_index"),
        F.create_map(
            F.lit("workspace_id"), F.when(key % 9 == 0, "").otherwise("4"),
            F.lit("prompt"), F.col("c_mktsegment"),
            F.lit("image"), F.when(key % 2 == 0, uri(key)).otherwise("none"),
            F.lit("refs"), F.when(key % 3 == 0, F.to_json(F.array(uri(key + 1), uri(key + 2)))).otherwise("none"),
        ).alias("args"),
    )


BATCH = """b AS (SELECT c_custkey AS row_index, c_custkey % 9 <> 0 AS has_ws,
    CASE WHEN c_custkey % 2 = 0 THEN 'gs://assets/' || (c_custkey % 500) || '.jpg' END AS u0,
    CASE WHEN c_custkey % 3 = 0 THEN 'gs://assets/' || ((c_custkey + 1) % 500) || '.jpg' END AS u1,
    CASE WHEN c_custkey % 3 = 0 THEN 'gs://assets/' || ((c_custkey + 2) % 500) || '.jpg' END AS u2 FROM customer),
known AS (SELECT gcs_uri, min(id) AS id FROM source_assets WHERE deleted_at IS NULL GROUP BY 1),
r AS (SELECT b.*, a0.id AS i0, a1.id AS i1, a2.id AS i2 FROM b LEFT JOIN known a0 ON a0.gcs_uri = u0 LEFT JOIN known a1 ON a1.gcs_uri = u1 LEFT JOIN known a2 ON a2.gcs_uri = u2),
faults AS (SELECT *, CASE WHEN u0 IS NULL THEN NULL WHEN NOT has_ws THEN 'Invalid GCS URI in ''image'': No workspace_id provided for GCS ingestion.'
      WHEN i0 IS NULL THEN 'Invalid GCS URI in ''image'': not found: ' || u0 END AS f0,
    CASE WHEN u1 IS NULL THEN NULL WHEN NOT has_ws THEN 'Invalid GCS URI in ''refs'': No workspace_id provided for GCS ingestion.'
      WHEN i1 IS NULL THEN 'Invalid GCS URI in ''refs'': not found: ' || u1
      WHEN i2 IS NULL THEN 'Invalid GCS URI in ''refs'': not found: ' || u2 END AS f1 FROM r)"""


@query("m10_batch_args", f"""
WITH {BATCH} SELECT row_index, CASE WHEN coalesce(f0, f1) IS NULL THEN 'SUCCESS' ELSE 'FAILED' END AS status, coalesce(f0, f1, '') AS error,
  CASE WHEN coalesce(f0, f1) IS NOT NULL THEN '' WHEN u0 IS NULL THEN 'none' ELSE '{{"sourceAssetId":' || i0 || ',"previewUrl":"' || u0 || '"}}' END AS image,
  CASE WHEN coalesce(f0, f1) IS NOT NULL THEN '' WHEN u1 IS NULL THEN 'none' ELSE '[{{"sourceAssetId":' || i1 || ',"previewUrl":"' || u1 || '"}},{{"sourceAssetId":' || i2 || ',"previewUrl":"' || u2 || '"}}]' END AS refs
FROM faults
""")
def m10(m):
    out = ln.rewrite_batch_args(_batch(m), m.source_assets)
    return out.select(
        "row_index", "status", F.coalesce("error", F.lit("")).alias("error"),
        F.coalesce(F.col("args")["image"], F.lit("")).alias("image"), F.coalesce(F.col("args")["refs"], F.lit("")).alias("refs"),
    )


@query("a13_batch_outcome", f"""
WITH {BATCH} SELECT count(*) FILTER (WHERE coalesce(f0, f1) IS NULL) AS succeeded, count(*) FILTER (WHERE coalesce(f0, f1) IS NOT NULL) AS failed FROM faults
""")
def a13(m):
    return ln.batch_outcome(ln.rewrite_batch_args(_batch(m), m.source_assets))
