"""Localization queries: grids, glossaries, translations, review."""

from __future__ import annotations

from pyspark.sql import functions as F

from loometry import fixed
from loometry.functions import text as tx
from loometry.functions.review import content_hash, link_status
from loometry.operators import localization as loc
from loometry.operators.changes import insert_ignore
from loometry.operators.paging import page_rows
from loometry.plans.bindings import MARKETS_SQL
from loometry.plans.media import TS, flat
from loometry.plans.registry import query
from loometry.session import cut_lineage

# The copy sheets number their rows with wide gaps (see ``copy_grid``), so a chunk
# spans more row numbers than the default.
SPARSE_ROWS = 1 << 36
NOW = "2024-02-10 12:00:00"
ALL_MARKETS = ", ".join(f"'{m}'" for m in fixed.MARKETS)
STRIP = "trim({0}, E' \\t\\n\\r')"

GRID_HEADS = f"""heads AS (SELECT sheet_idx, min(row_idx) AS header_row, arg_min(cells, row_idx) AS head FROM glossary_grid
  WHERE row_idx < 8 AND list_contains(list_transform(cells, lambda c: upper(c)), 'EN') GROUP BY 1),
cols AS (SELECT sheet_idx, header_row, market, max(i) AS i FROM (
  SELECT sheet_idx, header_row, CASE upper(cell) WHEN 'NOR' THEN 'NO' ELSE upper(cell) END AS market, i FROM (
    SELECT sheet_idx, header_row, unnest(head) AS cell, generate_subscripts(head, 1) AS i FROM heads))
  WHERE market IN ({ALL_MARKETS}) GROUP BY 1, 2, 3)"""
GRID_TERMS = f"""{GRID_HEADS},
terms AS (SELECT g.sheet_idx, g.row_idx, c.market, g.cells[e.i] AS source, g.cells[c.i] AS target
  FROM glossary_grid g JOIN cols c ON c.sheet_idx = g.sheet_idx AND c.market <> 'EN' AND g.row_idx > c.header_row
  JOIN cols e ON e.sheet_idx = g.sheet_idx AND e.market = 'EN'
  WHERE coalesce(g.cells[e.i], '') <> '' AND coalesce(g.cells[c.i], '') <> '' AND g.cells[c.i] <> g.cells[e.i]),
first_in_sheet AS (SELECT * FROM terms QUALIFY row_number() OVER (PARTITION BY sheet_idx, market, source ORDER BY row_idx) = 1),
final_terms AS (SELECT market, source, target FROM first_in_sheet
  QUALIFY row_number() OVER (PARTITION BY market, source ORDER BY sheet_idx DESC) = 1)"""


@query("w4_market_header", f"WITH {GRID_HEADS} SELECT sheet_idx, header_row, market, i::BIGINT - 1 AS col FROM cols")
def w4(m):
    heads = loc.market_columns(m.glossary_grid, ["sheet_idx"])
    return heads.select("sheet_idx", "header_row", F.explode("columns").alias("market", "col")).withColumn(
        "col", F.col("col").cast("long")
    )


@query("s12_glossary_from_grid", f"WITH {GRID_TERMS} SELECT * FROM final_terms")
def s12(m):
    return loc.glossary_from_grid(m.glossary_grid)


@query("w6_first_in_sheet_last_sheet", f"WITH {GRID_TERMS} SELECT market, count(*) AS terms, count(DISTINCT target) AS targets FROM final_terms GROUP BY 1")
def w6(m):
    return loc.glossary_from_grid(m.glossary_grid).groupBy("market").agg(
        F.count(F.lit(1)).alias("terms"), F.count_distinct("target").alias("targets")
    )


COPY_ROWS = """marked AS (SELECT sheet, row_idx, cells, coalesce(cells[1], '') AS a, coalesce(cells[2], '') AS b, coalesce(cells[3], '') AS en,
    regexp_matches(coalesce(cells[1], ''), '(?i)^request\\s*nr') AS is_marker,
    lower(coalesce(cells[1], '')) IN ('email', 'requestor', 'date email', 'due', 'notes') AS is_meta FROM copy_grid),
numbered AS (SELECT *, sum(is_marker::INT) OVER (PARTITION BY sheet ORDER BY row_idx)::BIGINT - 1 AS request_index FROM marked),
requests AS (SELECT *, last_value(CASE WHEN a <> '' AND NOT is_meta AND NOT is_marker THEN a END IGNORE NULLS)
    OVER (PARTITION BY sheet, request_index ORDER BY row_idx) AS block FROM numbered WHERE request_index >= 0),
segs AS (SELECT sheet, request_index, row_number() OVER (PARTITION BY sheet, request_index ORDER BY row_idx) - 1 AS segment_index,
    block, trim(regexp_replace(b, '\\s*\\(.*?\\)\\s*$', ''), E' \\t\\n\\r') AS field, b AS label,
    coalesce(try_cast(nullif(regexp_extract(b, '(?i)max\\s*([0-9]+)', 1), '') AS BIGINT), -1) AS char_limit, en AS text
    FROM requests WHERE NOT is_marker AND NOT is_meta AND b <> '')"""


@query("w1_request_sessions", f"WITH {COPY_ROWS} SELECT sheet, row_idx, request_index FROM requests")
def w1(m):
    return loc.sheet_requests(m.copy_grid, rows=SPARSE_ROWS).select("sheet", "row_idx", "request_index")


@query("w2_forward_fill_block", f"WITH {COPY_ROWS} SELECT sheet, row_idx, block FROM requests WHERE NOT is_marker")
def w2(m):
    return loc.sheet_requests(m.copy_grid, rows=SPARSE_ROWS).filter("not is_marker").select("sheet", "row_idx", "block")


def request_rows(m):
    """Rows with their request, written once: several operators read them."""
    return cut_lineage(loc.sheet_requests(m.copy_grid, rows=SPARSE_ROWS), "requests")


@query("w3_request_metadata", f"""
WITH {COPY_ROWS}, vals AS (SELECT sheet, request_index, row_idx, lower(a) AS k, CASE WHEN en <> '' THEN en ELSE b END AS v FROM requests WHERE is_meta)
SELECT r.sheet, r.request_index, r.a AS request_label,
  (SELECT arg_max(v, row_idx) FROM vals x WHERE x.sheet = r.sheet AND x.request_index = r.request_index AND k = 'email') AS email,
  (SELECT arg_max(v, row_idx) FROM vals x WHERE x.sheet = r.sheet AND x.request_index = r.request_index AND k = 'due') AS due,
  coalesce(nullif((SELECT arg_max(v, row_idx) FROM vals x WHERE x.sheet = r.sheet AND x.request_index = r.request_index AND k = 'email'), ''), r.a) AS name
FROM requests r WHERE is_marker
""")
def w3(m):
    rows = request_rows(m)
    return loc.request_metadata(rows, m.copy_grid).select("sheet", "request_index", "request_label", "email", "due", "name")


@query("s13_segments_from_grid", f"WITH {COPY_ROWS} SELECT * FROM segs")
def s13(m):
    rows = request_rows(m)
    out = loc.request_segments(rows, m.copy_grid, chunk_rows=SPARSE_ROWS)
    return out.withColumn("char_limit", F.coalesce(F.col("char_limit").cast("long"), F.lit(-1)))


@query("a12_filled_segments", f"""
WITH {COPY_ROWS} SELECT r.sheet, r.request_index, r.a AS label,
  (SELECT count(*) FROM segs s WHERE s.sheet = r.sheet AND s.request_index = r.request_index AND s.text <> '') AS filled
FROM requests r WHERE is_marker
""")
def a12(m):
    rows = request_rows(m)
    return loc.filled_segments(rows, loc.request_segments(rows, m.copy_grid, chunk_rows=SPARSE_ROWS))


ALIGNED = """aligned AS (SELECT s.*, k.market, coalesce(t.text, '') AS translation FROM segments s
  JOIN (SELECT DISTINCT briefing_id, market FROM translations) k ON k.briefing_id = s.briefing_id
  LEFT JOIN translations t ON t.briefing_id = s.briefing_id AND t.market = k.market AND t.segment_index = s.segment_index)"""


@query("j8_positional_join", f"WITH {ALIGNED} SELECT briefing_id, market, segment_index, text, translation FROM aligned")
def j8(m):
    return loc.aligned(m.segments, m.translations).select("briefing_id", "market", "segment_index", "text", "translation")


@query("f16_over_limit", f"WITH {ALIGNED} SELECT briefing_id, market, segment_index, coalesce(length(translation) > char_limit AND char_limit > 0, false) AS over FROM aligned")
def f16(m):
    return loc.over_limit_texts(loc.aligned(m.segments, m.translations)).select("briefing_id", "market", "segment_index", "over")


EXPORT_MARKETS = ["UK", "NL", "FR", "DE"]


@query("s14_export_grid", "WITH have AS (SELECT DISTINCT briefing_id, market FROM translations) SELECT s.briefing_id, s.segment_index, " + """
  CASE WHEN s.segment_index = 0 OR s.block IS DISTINCT FROM lag(s.block) OVER (PARTITION BY s.briefing_id ORDER BY s.segment_index) THEN coalesce(s.block, '') ELSE '' END AS block,
  s.label, s.text AS "EN", """ + ", ".join(
    f"""CASE WHEN EXISTS (SELECT 1 FROM have h WHERE h.briefing_id = s.briefing_id AND h.market = '{x}')
  THEN coalesce((SELECT t.text FROM translations t WHERE t.briefing_id = s.briefing_id AND t.market = '{x}' AND t.segment_index = s.segment_index), '') END AS "{x}" """
    for x in EXPORT_MARKETS) + " FROM segments s")
def s14(m):
    return loc.export_grid(m.segments, m.translations, EXPORT_MARKETS)


SHEET_MARKETS = fixed.TARGET_MARKETS
_HAVE = "EXISTS (SELECT 1 FROM translations t WHERE t.briefing_id = {0} AND t.market = '{1}')"


@query("s14_export_sheet", f"""
WITH meta AS (SELECT id AS briefing_id, name, CASE WHEN id % 3 = 0 THEN 'r' || id || '@example.com' END AS email, CASE WHEN id % 2 = 0 THEN 'Team ' || id ELSE '' END AS requestor FROM briefings),
have AS (SELECT briefing_id, list(DISTINCT market) AS ms FROM translations GROUP BY 1),
tr AS (SELECT briefing_id, segment_index, market, max(text) AS text FROM translations GROUP BY ALL),
order_of AS (SELECT unnest({SHEET_MARKETS!r}) AS market, unnest(range(1, {len(SHEET_MARKETS) + 1})) AS place),
cells AS (SELECT s.briefing_id, s.segment_index, string_agg(coalesce(tr.text, ''), '|' ORDER BY place) AS texts
  FROM segments s JOIN have h ON h.briefing_id = s.briefing_id JOIN order_of o ON list_contains(h.ms, o.market)
  LEFT JOIN tr ON tr.briefing_id = s.briefing_id AND tr.segment_index = s.segment_index AND tr.market = o.market GROUP BY 1, 2)
SELECT m.briefing_id, 0 AS part, 0::BIGINT AS line, '||EN' || coalesce((SELECT string_agg('|' || market, '' ORDER BY place) FROM order_of WHERE list_contains(h.ms, market)), '') AS cells
FROM meta m LEFT JOIN have h ON h.briefing_id = m.briefing_id
UNION ALL SELECT briefing_id, 1, 0, name FROM meta
UNION ALL SELECT briefing_id, 1, 1, 'Email||' || email FROM meta WHERE coalesce(email, '') <> ''
UNION ALL SELECT briefing_id, 1, 2, 'Requestor||' || requestor FROM meta WHERE coalesce(requestor, '') <> ''
UNION ALL SELECT briefing_id, 2, 0, '' FROM meta
UNION ALL SELECT s.briefing_id, 3, s.segment_index, CASE WHEN s.segment_index = 0 OR s.block IS DISTINCT FROM lag(s.block) OVER (PARTITION BY s.briefing_id ORDER BY s.segment_index) THEN coalesce(s.block, '') ELSE '' END
  || '|' || coalesce(s.label, '') || '|' || coalesce(s.text, '') || coalesce('|' || c.texts, '') FROM segments s LEFT JOIN cells c ON c.briefing_id = s.briefing_id AND c.segment_index = s.segment_index
""")
def s14_sheet(m):
    key = F.col("id")
    meta = m.briefings.select(
        key.alias("briefing_id"), "name", F.when(key % 3 == 0, F.concat(F.lit("r"), key.cast("string"), F.lit("@example.com"))).alias("email"),
        F.when(key % 2 == 0, F.concat(F.lit("Team "), key.cast("string"))).otherwise("").alias("requestor"),
        *[F.lit(None).cast("string").alias(c) for c in ("date_email", "due", "notes")],
    )
    return loc.export_sheet(meta, m.segments, m.translations).withColumn("cells", F.array_join("cells", "|"))


@query("w11_block_label_once", """
SELECT briefing_id, count(*) FILTER (WHERE shown <> '') AS labels, count(*) AS segments FROM (
  SELECT briefing_id, CASE WHEN segment_index = 0 OR block IS DISTINCT FROM lag(block) OVER (PARTITION BY briefing_id ORDER BY segment_index) THEN coalesce(block, '') ELSE '' END AS shown
  FROM segments) GROUP BY 1
""")
def w11(m):
    grid = loc.export_grid(m.segments, m.translations, [])
    return grid.groupBy("briefing_id").agg(F.count_if(F.col("block") != "").alias("labels"), F.count(F.lit(1)).alias("segments"))


TERM_HITS = """joined AS (SELECT briefing_id, lower(string_agg(text, ' ' || chr(10) || ' ' ORDER BY segment_index)) AS t FROM segments WHERE coalesce(text, '') <> '' GROUP BY 1),
hits AS (SELECT k.briefing_id, k.market, g.id AS term_id, g.source, g.target,
    row_number() OVER (PARTITION BY k.briefing_id, k.market ORDER BY g.id) AS rank
  FROM (SELECT DISTINCT briefing_id, market FROM translations) k JOIN joined j ON j.briefing_id = k.briefing_id
  JOIN glossary_terms g ON g.language = k.market AND g.source <> '' AND contains(j.t, lower(g.source)))"""


@query("j9_glossary_containment", f"WITH {TERM_HITS} SELECT briefing_id, market, term_id, source, target, rank FROM hits WHERE rank <= 60")
def j9(m):
    out = loc.relevant_terms(m.segments, m.glossary_terms, m.translations)
    return out.select("briefing_id", "market", "term_id", "source", "target", F.col("rank").cast("long").alias("rank"))


@query("prompt_lines", f"""
WITH {TERM_HITS}, k AS (SELECT DISTINCT briefing_id, market FROM translations WHERE briefing_id IN (SELECT briefing_id FROM segments WHERE {STRIP.format("coalesce(text, '')")} <> '')),
items AS (SELECT briefing_id, row_number() OVER (PARTITION BY briefing_id ORDER BY segment_index) - 1 AS n, * EXCLUDE (briefing_id) FROM segments WHERE {STRIP.format("coalesce(text, '')")} <> '')
SELECT briefing_id, market, 2 AS part, 0::BIGINT AS line, '{fixed.PROMPT_GLOSSARY}' AS text FROM hits GROUP BY 1, 2
UNION ALL SELECT briefing_id, market, 3, rank, '    "' || source || '" -> "' || target || '"' FROM hits WHERE rank <= 60
UNION ALL SELECT k.briefing_id, market, 5, n, n || '. [' || CASE WHEN coalesce(block, '') <> '' THEN block || '/' || field ELSE field END
  || CASE WHEN char_limit > 0 THEN ' (max ' || char_limit || ' chars)' ELSE '' END || ']: ' || text FROM items i JOIN k ON k.briefing_id = i.briefing_id
UNION ALL SELECT briefing_id, market, 1, 0, 'You are a senior marketing copy translator. Translate the following email campaign copy from English into '
  || CASE market {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.MARKETS.items())} END || '.' FROM k
UNION ALL SELECT briefing_id, market, 1, 1, 'Rules:' FROM k
""" + "".join(f"UNION ALL SELECT briefing_id, market, 1, {i + 2}, '{r}' FROM k\n" for i, r in enumerate(fixed.PROMPT_RULES)) + f"""
UNION ALL SELECT briefing_id, market, 1, {len(fixed.PROMPT_RULES) + 2}, '- Use a formal tone of voice / form of address.' FROM k
UNION ALL SELECT briefing_id, market, 4, 0, '' FROM k UNION ALL SELECT briefing_id, market, 4, 1, '{fixed.PROMPT_FORMAT}' FROM k
UNION ALL SELECT briefing_id, market, 4, 2, '' FROM k UNION ALL SELECT briefing_id, market, 4, 3, '{fixed.PROMPT_ITEMS}' FROM k
""")
def prompts(m):
    hits = loc.relevant_terms(m.segments, m.glossary_terms, m.translations)
    out = loc.prompt_lines(m.segments, m.translations, hits, tone="formal")
    return out.withColumn("line", F.col("line").cast("long"))


@query("json_reply", f"""
WITH k AS (SELECT DISTINCT briefing_id, market FROM translations),
n AS (SELECT *, sum(({STRIP.format("text")} <> '')::INT) OVER (PARTITION BY briefing_id ORDER BY segment_index) - 1 AS n FROM segments)
SELECT k.briefing_id, k.market, segment_index, CASE WHEN {STRIP.format("text")} = '' THEN '' WHEN n = 0 THEN 'first ' || k.briefing_id
  WHEN n = 2 AND k.briefing_id % 2 = 0 THEN 'third' ELSE text END AS text
FROM n JOIN k ON k.briefing_id = n.briefing_id
""")
def json_reply(m):
    pairs = m.translations.select("briefing_id", "market").distinct()
    ident = F.col("briefing_id").cast("string")
    third = F.when(F.col("briefing_id") % 2 == 0, F.lit(', "2": " third "')).otherwise(F.lit(', "2": null'))
    reply = F.concat(F.lit('```json\n{"0": "first '), ident, F.lit('"'), third, F.lit("}\n```"))
    return loc.apply_replies(m.segments, pairs.withColumn("reply", reply))


OVERVIEW = f"""counts AS (SELECT briefing_id, market, count(*) FILTER (WHERE status = 'open') AS open, count(*) FILTER (WHERE status = 'in_progress') AS in_progress,
  count(*) FILTER (WHERE status = 'resolved') AS resolved FROM tickets GROUP BY 1, 2),
link AS (SELECT *, CASE WHEN coalesce(token_hash, '') = '' THEN 'none' WHEN revoked_at IS NOT NULL THEN 'revoked'
  WHEN expires_at IS NULL OR expires_at <= TIMESTAMP '{NOW}' THEN 'expired' ELSE 'active' END AS link_status FROM feedback_requests)"""


@query("j16_review_overview", f"""
WITH {OVERVIEW} SELECT coalesce(l.briefing_id, c.briefing_id) AS briefing_id, coalesce(l.market, c.market) AS market,
  coalesce(review_state, 'draft') AS review_state, coalesce(link_status, 'none') AS link_status,
  coalesce({TS.format('expires_at')}, '') AS expires_at, coalesce(open, 0) AS open, coalesce(in_progress, 0) AS in_progress, coalesce(resolved, 0) AS resolved
FROM link l FULL JOIN counts c ON c.briefing_id = l.briefing_id AND c.market = l.market
""")
def j16(m):
    out = loc.review_overview(m.feedback_requests, m.tickets, F.lit(NOW).cast("timestamp"))
    return out.withColumn("expires_at", F.coalesce(F.date_format("expires_at", "yyyy-MM-dd HH:mm:ss"), F.lit("")))


@query("case_link_status", f"WITH {OVERVIEW} SELECT briefing_id, market, link_status FROM link")
def case_link(m):
    status = link_status(F.col("token_hash"), F.col("revoked_at"), F.col("expires_at"), F.lit(NOW).cast("timestamp"))
    return m.feedback_requests.select("briefing_id", "market", status.alias("link_status"))


@query("u3_market_keys", "SELECT briefing_id, market FROM feedback_requests UNION SELECT briefing_id, market FROM tickets")
def u3(m):
    return loc.market_keys(m.feedback_requests, m.tickets)


@query("a7_ticket_counts", f"WITH {OVERVIEW} SELECT * FROM counts")
def a7(m):
    return loc.ticket_counts(m.tickets)


@query("a14_segment_tickets", """
SELECT briefing_id, market, segment_index, count(*) FILTER (WHERE status <> 'resolved') AS unresolved, count(*) FILTER (WHERE status = 'resolved') AS resolved
FROM tickets GROUP BY 1, 2, 3
""")
def a14(m):
    return loc.segment_tickets(m.tickets)


@query("a15_market_progress", """
SELECT briefing_id, count(*) AS selected, count(*) FILTER (WHERE review_state <> 'draft') AS done, count(*) FILTER (WHERE review_state = 'done') AS approved
FROM feedback_requests GROUP BY 1
""")
def a15(m):
    states = m.feedback_requests.select(
        "briefing_id", "market", F.when(F.col("review_state") == "draft", "idle").otherwise("done").alias("status"),
        F.when(F.col("review_state") == "done", "approved").otherwise("pending").alias("approval"),
    )
    return loc.market_progress(states)


CURRENT = f"""current AS (SELECT s.briefing_id, k.market, s.segment_index, sha256({STRIP.format('s.field')} || chr(1) || {STRIP.format('s.text')} || chr(1) || {STRIP.format("coalesce(t.text, '')")}) AS h
  FROM segments s JOIN (SELECT DISTINCT briefing_id, market FROM tickets) k ON k.briefing_id = s.briefing_id
  LEFT JOIN translations t ON t.briefing_id = s.briefing_id AND t.market = k.market AND t.segment_index = s.segment_index),
flagged AS (SELECT t.*, coalesce(t.content_hash <> c.h, false) AS item_changed FROM tickets t
  LEFT JOIN current c ON c.briefing_id = t.briefing_id AND c.market = t.market AND c.segment_index = t.segment_index)"""


@query("case_drift_flag", f"WITH {CURRENT} SELECT id, briefing_id, market, segment_index, item_changed FROM flagged")
def drift(m):
    return loc.flag_changed(m.tickets, m.segments, m.translations).select("id", "briefing_id", "market", "segment_index", "item_changed")


@query("hash_content", f"""
WITH {ALIGNED} SELECT briefing_id, market, segment_index, sha256({STRIP.format('field')} || chr(1) || {STRIP.format('text')} || chr(1) || {STRIP.format('translation')}) AS hash FROM aligned
""")
def hash_content(m):
    rows = loc.aligned(m.segments, m.translations)
    return rows.select("briefing_id", "market", "segment_index", content_hash(F.col("field"), F.col("text"), F.col("translation")).alias("hash"))


@query("f20_public_view", f"""
SELECT s.briefing_id, r.market, s.segment_index, block, field, label, coalesce(char_limit, -1)::BIGINT AS char_limit, s.text AS source, coalesce(t.text, '') AS translation
FROM segments s JOIN feedback_requests r ON r.briefing_id = s.briefing_id
LEFT JOIN translations t ON t.briefing_id = s.briefing_id AND t.market = r.market AND t.segment_index = s.segment_index
""")
def f20(m):
    out = loc.public_items(m.segments, m.translations, m.feedback_requests)
    return out.withColumn("char_limit", F.coalesce(F.col("char_limit").cast("long"), F.lit(-1)))


@query("f20_public_tickets", f"WITH {CURRENT} SELECT briefing_id, market, id, segment_index, author_name, status, {TS.format('created_at')} AS created_at, item_changed FROM flagged")
def f20b(m):
    out = loc.public_tickets(m.tickets, m.segments, m.translations)
    return flat(out, *out.columns)


@query("l6_oldest_tickets", f"SELECT id, market, {TS.format('created_at')} AS created_at FROM tickets WHERE briefing_id = 3 ORDER BY created_at, id LIMIT 100")
def l6(m):
    found = m.tickets.filter(F.col("briefing_id") == 3)
    return flat(page_rows(found, [F.col("created_at"), F.col("id")], 100), "id", "market", "created_at")


@query("l6_latest_briefings", f"SELECT id, name, {TS.format('created_at')} AS created_at FROM briefings ORDER BY created_at DESC, id LIMIT 100")
def l6b(m):
    return flat(page_rows(m.briefings, [F.col("created_at").desc(), F.col("id")], 100), "id", "name", "created_at")


@query("f17_glossary_search", "SELECT id, language, source, target FROM glossary_terms WHERE contains(lower(source), 'er') OR contains(lower(target), 'er') ORDER BY lower(source), id LIMIT 500")
def f17(m):
    return loc.search_glossary(m.glossary_terms, text="ER").select("id", "language", "source", "target")


SAMPLES = "samples AS (SELECT language, source, target, row_number() OVER (PARTITION BY language ORDER BY id) AS rank FROM glossary_terms QUALIFY rank <= 3)"


@query("w5_first_per_group", f"WITH {SAMPLES} SELECT language, rank, source, target FROM samples")
def w5(m):
    return loc.glossary_samples(m.glossary_terms).withColumn("rank", F.col("rank").cast("long"))


@query("a8_glossary_summary", f"""
WITH {SAMPLES} SELECT language AS market, count(*) AS count, (SELECT count(*) FROM glossary_terms) AS total,
  (SELECT string_agg(source || '=' || target, '|' ORDER BY rank) FROM samples s WHERE s.language = g.language) AS samples
FROM glossary_terms g GROUP BY 1
""")
def a8(m):
    out = loc.glossary_summary(m.glossary_terms)
    text = F.transform("samples", lambda s: F.concat_ws("=", s["source"], s["target"]))
    return out.withColumn("samples", F.array_join(text, "|"))


@query("j15_insert_ignore", f"""
WITH {GRID_TERMS} SELECT language, source, target FROM glossary_terms
UNION ALL SELECT market, source, target FROM final_terms f WHERE NOT EXISTS (SELECT 1 FROM glossary_terms g WHERE g.language = f.market AND g.source = f.source)
""")
def j15(m):
    table = m.glossary_terms.select("language", "source", "target")
    rows = loc.glossary_from_grid(m.glossary_grid).withColumnRenamed("market", "language").select("language", "source", "target")
    return insert_ignore(table, rows, ["language", "source"], [F.col("target")])


@query("m12_check_tickets", f"""
WITH d AS (SELECT event_id AS id, user_id AS briefing_id, {MARKETS_SQL}[(event_id % 14) + 1] AS market, (event_id % 9)::INT AS segment_index,
    CASE WHEN event_id % 10 = 0 THEN '  ' ELSE ' Ann ' END AS author_name, CASE WHEN event_id % 7 = 0 THEN '' ELSE 'body ' || event_id END AS body FROM events)
SELECT d.id, trim(author_name) AS author_name, body, s.label AS field_snapshot_all,
  CASE WHEN s.briefing_id IS NULL THEN 'segment_index is out of range for this briefing.'
    WHEN trim(author_name) = '' OR trim(body) = '' THEN 'Both a name and a non-empty comment are required.' ELSE '' END AS error,
  CASE WHEN s.briefing_id IS NOT NULL AND trim(author_name) <> '' AND trim(body) <> '' THEN
    sha256({STRIP.format('s.field')} || chr(1) || {STRIP.format('s.text')} || chr(1) || {STRIP.format("coalesce(t.text, '')")}) END AS content_hash
FROM d LEFT JOIN segments s ON s.briefing_id = d.briefing_id AND s.segment_index = d.segment_index
LEFT JOIN translations t ON t.briefing_id = d.briefing_id AND t.market = d.market AND t.segment_index = d.segment_index
""".replace("s.label AS field_snapshot_all", "CASE WHEN s.briefing_id IS NOT NULL AND trim(author_name) <> '' AND trim(body) <> '' THEN s.label END AS field_snapshot"))
def m12(m):
    key = F.col("event_id")
    markets = F.array(*[F.lit(x) for x in fixed.TARGET_MARKETS])
    drafts = m.raw("events").select(
        key.alias("id"), F.col("user_id").alias("briefing_id"),
        F.get(markets, (key % 14).cast("int")).alias("market"), (key % 9).cast("int").alias("segment_index"),
        F.when(key % 10 == 0, "  ").otherwise(" Ann ").alias("author_name"),
        F.when(key % 7 == 0, "").otherwise(F.concat(F.lit("body "), key.cast("string"))).alias("body"),
    )
    out = loc.check_tickets(drafts, m.segments, m.translations)
    return out.select("id", "author_name", "body", "field_snapshot", F.coalesce("error", F.lit("")).alias("error"), "content_hash")


@query("text_field_and_limit", """
SELECT briefing_id, segment_index, trim(regexp_replace(label, '\\s*\\(.*?\\)\\s*$', '')) AS field, regexp_extract(label, '(?i)max\\s*([0-9]+)', 1)::BIGINT AS char_limit FROM segments
""")
def field_and_limit(m):
    label = F.col("label")
    return m.segments.select("briefing_id", "segment_index", tx.field_name(label).alias("field"), tx.char_limit(label).cast("long").alias("char_limit"))


@query("hash_bytes", "SELECT doc_id, sha256(text) AS hash FROM documents")
def hash_bytes(m):
    return m.raw("documents").select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("hash"))
