"""Table changes, deduplication and research text."""

from __future__ import annotations

from pyspark.sql import functions as F

from loometry.functions.text import display_value, progress_text
from loometry.operators import changes as ch
from loometry.operators import research as rs
from loometry.plans.media import TS, flat
from loometry.plans.registry import query

NOW = "2003-01-01 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


def keys(m, mod):
    """Keys to act on: orders of every ``mod``-th customer."""
    return m.raw("orders").filter(F.col("o_custkey") % mod == 0).select(F.col("o_orderkey").alias("id"))


def stamp(name):
    return F.coalesce(F.date_format(name, "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias(name)


KEYS = "(SELECT o_orderkey FROM orders WHERE o_custkey % {0} = 0)"


@query("m1_soft_delete", f"""
SELECT id, coalesce({TS.format(f"CASE WHEN deleted_at IS NULL AND id IN {KEYS.format(5)} THEN TIMESTAMP '{NOW}' ELSE deleted_at END")}, '') AS deleted_at,
  coalesce(CASE WHEN deleted_at IS NULL AND id IN {KEYS.format(5)} THEN 42 ELSE deleted_by END, -1)::BIGINT AS deleted_by FROM media_items
""")
def m1(m):
    out = ch.soft_delete(m.media_items, keys(m, 5), now(), by=42)
    return out.select("id", stamp("deleted_at"), F.coalesce("deleted_by", F.lit(-1)).alias("deleted_by"))


@query("m1_restore", f"""
SELECT id, coalesce({TS.format(f"CASE WHEN id IN {KEYS.format(5)} THEN NULL ELSE deleted_at END")}, '') AS deleted_at,
  coalesce(CASE WHEN id IN {KEYS.format(5)} THEN NULL ELSE deleted_by END, -1)::BIGINT AS deleted_by FROM media_items
""")
def m1b(m):
    out = ch.restore(m.media_items, keys(m, 5))
    return out.select("id", stamp("deleted_at"), F.coalesce("deleted_by", F.lit(-1)).alias("deleted_by"))


@query("m2_hard_delete", f"SELECT media_item_id, tag_id FROM media_item_tags WHERE media_item_id NOT IN {KEYS.format(4)}")
def m2(m):
    doomed = keys(m, 4).select(F.col("id").alias("media_item_id"))
    return ch.hard_delete(m.media_item_tags, doomed, ["media_item_id"])


@query("m3_partial_update", f"""
SELECT i.id, coalesce(u.prompt, i.prompt) AS prompt, i.style, {TS.format(f"CASE WHEN u.id IS NOT NULL THEN TIMESTAMP '{NOW}' ELSE updated_at END")} AS updated_at
FROM media_items i LEFT JOIN (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'new ' || o_orderkey END AS prompt FROM orders WHERE o_custkey % 3 = 0) u ON u.id = i.id
""")
def m3(m):
    key = F.col("o_orderkey")
    updates = m.raw("orders").filter("o_custkey % 3 = 0").select(
        key.alias("id"), F.when(key % 2 == 0, F.concat(F.lit("new "), key.cast("string"))).alias("prompt")
    )
    return ch.partial_update(m.media_items, updates, now()).select("id", "prompt", "style", stamp("updated_at"))


@query("m4_stop_stuck_jobs", "SELECT status, count(*) AS count FROM (SELECT CASE WHEN status = 'processing' AND created_at < TIMESTAMP '1999-01-01 01:00:00' - INTERVAL 1 HOUR THEN 'stopped' ELSE status END AS status FROM media_items) GROUP BY 1")
def m4(m):
    out = ch.stop_stuck_jobs(m.media_items, F.lit("1999-01-01 01:00:00").cast("timestamp"))
    return out.groupBy("status").agg(F.count(F.lit(1)).alias("count"))


@query("m5_insert_ignore", """
SELECT user_id, file_hash, id FROM source_assets WHERE id % 2 = 0 AND (user_id, file_hash, id) IN (SELECT (user_id, file_hash, min(id)) FROM source_assets WHERE id % 2 = 0 GROUP BY user_id, file_hash)
UNION ALL
SELECT user_id, file_hash, min(id) FROM source_assets WHERE id % 2 = 1
  AND (user_id, file_hash) NOT IN (SELECT (user_id, file_hash) FROM source_assets WHERE id % 2 = 0) GROUP BY 1, 2
""")
def m5(m):
    table = m.source_assets.select("user_id", "file_hash", "id")
    stored = ch.one_row(table.filter("id % 2 = 0"), ["user_id", "file_hash"], [F.col("id")])
    return ch.insert_ignore(stored, table.filter("id % 2 = 1"), ["user_id", "file_hash"], [F.col("id")])


@query("m6_replace_by_key", """
SELECT briefing_id, market, segment_index, text FROM translations WHERE briefing_id % 2 <> 0
UNION ALL SELECT briefing_id, market, segment_index, 'redone' FROM translations WHERE briefing_id % 2 = 0 AND segment_index < 3
""")
def m6(m):
    redone = m.translations.filter("briefing_id % 2 = 0 and segment_index < 3").withColumn("text", F.lit("redone"))
    return ch.replace_by_key(m.translations, redone, ["briefing_id", "market"])


@query("m7_upsert", """
SELECT coalesce(r.briefing_id, t.briefing_id) AS briefing_id, coalesce(r.market, t.market) AS market,
  CASE WHEN t.briefing_id IS NOT NULL THEN 'in_review' ELSE review_state END AS review_state, coalesce(token_hash, '') AS token_hash
FROM feedback_requests r FULL JOIN (SELECT DISTINCT briefing_id, market FROM tickets WHERE status = 'open') t ON t.briefing_id = r.briefing_id AND t.market = r.market
""")
def m7(m):
    rows = m.tickets.filter("status = 'open'").select("briefing_id", "market").distinct().withColumn("review_state", F.lit("in_review"))
    out = ch.upsert(m.feedback_requests, rows, ["briefing_id", "market"])
    return out.select("briefing_id", "market", "review_state", F.coalesce("token_hash", F.lit("")).alias("token_hash"))


WANTED = """wanted AS (SELECT workspace_id, name, min(pos) AS pos FROM (
    SELECT c_nationkey::BIGINT AS workspace_id, CASE WHEN c_custkey % 2 = 0 THEN 'tag' || (c_custkey % 10) ELSE 'new ' || (c_custkey % 13) END AS name, c_custkey AS pos FROM customer) GROUP BY 1, 2),
fresh AS (SELECT * FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM tags t WHERE t.workspace_id = w.workspace_id AND t.name = w.name)),
added AS (SELECT (SELECT max(id) FROM tags) + row_number() OVER (ORDER BY pos) AS id, name, workspace_id,
    (coalesce((SELECT count(*) FROM tags t WHERE t.workspace_id = f.workspace_id), 0) + row_number() OVER (PARTITION BY workspace_id ORDER BY pos) - 1) AS before FROM fresh f)"""


def wanted_tags(m):
    key = F.col("c_custkey")
    return m.raw("customer").select(
        F.col("c_nationkey").cast("long").alias("workspace_id"),
        F.when(key % 2 == 0, F.concat(F.lit("tag"), (key % 10).cast("string")))
        .otherwise(F.concat(F.lit("new "), (key % 13).cast("string"))).alias("name"),
        key.alias("pos"),
    )


PALETTE = "[" + ", ".join(f"'{c}'" for c in ch.fixed.TAG_COLORS) + "]"


@query("w10_tag_colours", f"WITH {WANTED} SELECT id, name, workspace_id, {PALETTE}[(before % {len(ch.fixed.TAG_COLORS)}) + 1] AS color FROM added")
def w10(m):
    return ch.create_tags(m.tags, wanted_tags(m), 7, now()).select("id", "name", "workspace_id", "color")


@query("m8_assign_tags", f"""
WITH {WANTED}, every AS (SELECT id, name, workspace_id FROM tags UNION ALL SELECT id, name, workspace_id FROM added),
ids AS (SELECT e.workspace_id, e.name, min(e.id) AS tag_id FROM every e WHERE (e.workspace_id, e.name) IN (SELECT (workspace_id, name) FROM wanted) GROUP BY 1, 2),
items AS (SELECT id AS media_item_id, workspace_id FROM media_items WHERE status = 'failed')
SELECT media_item_id, tag_id FROM media_item_tags WHERE media_item_id NOT IN (SELECT media_item_id FROM items)
UNION ALL SELECT media_item_id, tag_id FROM items JOIN ids ON ids.workspace_id = items.workspace_id
""")
def m8(m):
    items = m.media_items.filter("status = 'failed'").select(F.col("id").alias("media_item_id"), "workspace_id")
    _, links = ch.assign_tags(m.tags, m.media_item_tags, items, wanted_tags(m), 7, now())
    return links


@query("m8_tags_used", f"""
WITH {WANTED}, every AS (SELECT id, name, workspace_id, updated_at FROM tags UNION ALL SELECT id, name, workspace_id, TIMESTAMP '{NOW}' FROM added),
ids AS (SELECT min(e.id) AS tag_id FROM every e WHERE (e.workspace_id, e.name) IN (SELECT (workspace_id, name) FROM wanted) GROUP BY e.workspace_id, e.name)
SELECT id, name, {TS.format(f"CASE WHEN id IN (SELECT tag_id FROM ids) THEN TIMESTAMP '{NOW}' ELSE updated_at END")} AS updated_at FROM every
""")
def m8b(m):
    items = m.media_items.filter("status = 'failed'").select(F.col("id").alias("media_item_id"), "workspace_id")
    tags, _ = ch.assign_tags(m.tags, m.media_item_tags, items, wanted_tags(m), 7, now())
    return tags.select("id", "name", stamp("updated_at"))


@query("m9_bulk_copy", f"""
SELECT (SELECT max(id) FROM media_items) + row_number() OVER (ORDER BY id) AS id, 9::BIGINT AS workspace_id, 11::BIGINT AS user_id,
  'me@example.com' AS user_email, prompt, '{NOW}' AS created_at, '' AS deleted_at
FROM media_items WHERE deleted_at IS NULL AND id IN {KEYS.format(6)}
""")
def m9(m):
    out = ch.copies(m.media_items, keys(m, 6), ch.max_id(m.media_items) + 1, 9, 11, now(), "me@example.com")
    return out.select("id", "workspace_id", "user_id", "user_email", "prompt", stamp("created_at"), stamp("deleted_at"))


@query("s16_seed_missing", """
SELECT name, workspace_id FROM (SELECT min(workspace_id) AS workspace_id, name FROM tags GROUP BY name)
UNION ALL SELECT DISTINCT p_name, -1 FROM part WHERE p_name NOT IN (SELECT name FROM tags)
""")
def s16(m):
    table = m.tags.groupBy("name").agg(F.min("workspace_id").alias("workspace_id"))
    seeds = m.raw("part").select(F.col("p_name").alias("name"), F.lit(-1).cast("long").alias("workspace_id"))
    return ch.seed_missing(table, seeds, "name")


@query("w7_resolve_uploads", "SELECT id, user_id, first_value(id) OVER (PARTITION BY user_id, file_hash ORDER BY created_at, id) AS kept_id FROM source_assets")
def w7(m):
    return ch.resolve_uploads(m.source_assets).select("id", "user_id", "kept_id")


@query("w7_first_uploads", "SELECT id, user_id, file_hash FROM source_assets QUALIFY row_number() OVER (PARTITION BY user_id, file_hash ORDER BY created_at, id) = 1")
def w7b(m):
    return ch.first_uploads(m.source_assets).select("id", "user_id", "file_hash")


@query("w9_latest_per_key", f"SELECT workspace_id, id, original_filename, {TS.format('created_at')} AS created_at FROM source_assets QUALIFY row_number() OVER (PARTITION BY workspace_id ORDER BY created_at DESC, id DESC) = 1")
def w9(m):
    out = ch.latest_per_key(m.source_assets, ["workspace_id"], [F.col("created_at"), F.col("id")])
    return flat(out, "workspace_id", "id", "original_filename", "created_at")


PARTIALS = """SELECT n_nationkey AS brand, unnest(['#' || substr(sha256(p_name), 1, 1) || 'f0000', '#Ab' || (p_size % 9) || '000', '']) AS c
  FROM part JOIN nation ON n_nationkey = p_partkey % 25"""


def partials(m):
    return m.raw("part").select(
        (F.col("p_partkey") % 25).alias("brand"),
        F.array(
            F.concat(F.lit("#"), F.substring(F.sha2("p_name", 256), 1, 1), F.lit("f0000")),
            F.concat(F.lit("#Ab"), (F.col("p_size") % 9).cast("string"), F.lit("000")), F.lit(""),
        ).alias("color_palette"),
    )


@query("a11_palette_union", f"SELECT DISTINCT brand::BIGINT AS brand, upper(c) AS color FROM ({PARTIALS}) WHERE c <> ''")
def a11(m):
    return ch.merged_palette(partials(m), ["brand"])


# --- research text ------------------------------------------------------------------

LINES = """lines AS (SELECT id, i, line, last_value(CASE WHEN regexp_matches(line, '^\\s*#{1,6}\\s+(.*\\S)\\s*$') THEN regexp_extract(line, '^\\s*#{1,6}\\s+(.*\\S)\\s*$', 1) END IGNORE NULLS)
    OVER (PARTITION BY id ORDER BY i) AS heading FROM (SELECT id, unnest(string_split(research_plan, chr(10))) AS line, generate_subscripts(string_split(research_plan, chr(10)), 1) AS i FROM reports)),
items AS (SELECT id, i, heading, trim(regexp_extract(line, '^\\s*(?:[0-9]+[.)]|[-*•])\\s+(.*\\S)\\s*$', 1), E' \\t\\n\\r') AS item FROM lines
    WHERE regexp_matches(line, '^\\s*(?:[0-9]+[.)]|[-*•])\\s+(.*\\S)\\s*$'))"""


@query("w12_list_items", f"WITH {LINES} SELECT id, row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS pos, item FROM items WHERE contains(lower(heading), 'sub-question')")
def w12(m):
    items = rs.list_items(F.col("research_plan"), "sub-question")
    return m.reports.select("id", F.posexplode(items).alias("pos", "item")).withColumn("pos", F.col("pos").cast("long"))


TARGETS = f"""{LINES},
plan AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS pos, item FROM items WHERE contains(lower(heading), 'sub-question')),
gaps AS (SELECT id, 0 AS pos, trim(string_split(gap_analysis, chr(10))[2][2:], E' \\t\\n\\r') AS item FROM reports WHERE id % 3 = 0 AND trim(string_split(gap_analysis, chr(10))[2][2:], E' \\t\\n\\r') <> ''
  UNION ALL SELECT id, 1, 'gap two' FROM reports WHERE id % 3 = 0),
chosen AS (SELECT id, 'open gaps' AS focus, row_number() OVER (PARTITION BY id ORDER BY pos) - 1 AS pos, item AS target FROM gaps
  UNION ALL SELECT id, 'sub-questions', pos, item FROM plan WHERE id % 3 <> 0)"""


@query("w13_research_targets", f"WITH {TARGETS} SELECT id, focus, count(*) AS n, string_agg(target, '|' ORDER BY pos) AS targets FROM chosen GROUP BY 1, 2")
def w13(m):
    out = rs.research_targets(m.reports).filter(F.array_size("targets") > 0)
    return out.select("id", "focus", F.array_size("targets").cast("long").alias("n"), F.array_join("targets", "|").alias("targets"))


@query("w14_round_robin", f"""
WITH {TARGETS} SELECT id, focus, pos, target, pos % 3 AS slot FROM chosen
UNION ALL SELECT id, 'sub-questions', 0, 'Answer the overall research question using the plan above.', 0 FROM reports WHERE id NOT IN (SELECT id FROM chosen)
""")
def w14(m):
    out = rs.slot_targets(m.reports, 3)
    return out.withColumn("pos", F.col("pos").cast("long")).withColumn("slot", F.col("slot").cast("long"))


FRAGMENTS = """fragments AS (SELECT user_id AS id, event_id % 6 AS round, event_id AS slot,
  CASE WHEN event_id % 4 = 0 THEN '(no assignment)' WHEN event_id % 4 = 1 THEN '  ' ELSE ' found ' || event_id || chr(10) END AS text FROM events WHERE event_type <> 'view')"""


def fragments(m):
    key = F.col("event_id")
    return m.raw("events").filter("event_type <> 'view'").select(
        F.col("user_id").alias("id"), (key % 6).alias("round"), key.alias("slot"),
        F.when(key % 4 == 0, "(no assignment)").when(key % 4 == 1, "  ")
        .otherwise(F.concat(F.lit(" found "), key.cast("string"), F.lit("\n"))).alias("text"),
    )


@query("w15_merge_findings", f"""
WITH {FRAGMENTS}, kept AS (SELECT *, dense_rank() OVER (PARTITION BY id ORDER BY round) AS round_no FROM (
  SELECT id, round, slot, trim(text, E' \\t\\n\\r') AS text FROM fragments) WHERE text NOT IN ('', '(no assignment)'))
SELECT id, round_no, slot, text FROM kept
""")
def w15(m):
    out = rs.merge_findings(fragments(m)).select("id", "round_no", "slot", "text")
    return out.withColumn("round_no", F.col("round_no").cast("long"))


@query("w16_flagged_claims", f"WITH {LINES} SELECT id, row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS pos, item AS claim FROM items WHERE contains(lower(heading), 'caution')")
def w16(m):
    return rs.flagged_claims(m.reports, "research_plan").withColumn("pos", F.col("pos").cast("long"))


@query("text_final_report", """
SELECT id, CASE WHEN trim(coalesce(gap_analysis, ''), E' \\t\\n\\r') = '' THEN trim(coalesce(research_plan, ''), E' \\t\\n\\r')
  ELSE trim(coalesce(research_plan, ''), E' \\t\\n\\r') || chr(10) || chr(10) || '---' || chr(10) || chr(10) || trim(gap_analysis, E' \\t\\n\\r') END AS report FROM reports
""")
def final(m):
    return m.reports.select("id", rs.final_report(F.col("research_plan"), F.col("gap_analysis")).alias("report"))


@query("text_progress", """
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text ELSE left(text, 200) END AS text FROM documents
""")
def progress(m):
    kind = F.when(F.col("doc_id") % 2 == 0, "tool").otherwise("text")
    return m.raw("documents").select("doc_id", progress_text(kind, F.col("text")).alias("text"))


@query("text_display_value", """
SELECT id, coalesce(nullif(array_to_string(list_filter(list_transform(roles, lambda r: trim(r)), lambda r: r <> ''), ', '), ''), '(not specified)') AS shown FROM users
""")
def display(m):
    return m.users.select("id", display_value(F.col("roles")).alias("shown"))
