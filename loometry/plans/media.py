"""Gallery queries: the unified table, its filters, joins, paging and rights."""

from __future__ import annotations

from pyspark.sql import functions as F

from loometry.functions.media import asset_type_from_filename, mime_matches, moment_range, nearest_ratio, not_deleted, time_bucket
from loometry.functions.text import any_contains_ci
from loometry.operators import gallery as g
from loometry.operators.paging import deep_page_rows, page_rows
from loometry.operators.lineage import enrich_asset_links, parent_links
from loometry.plans.registry import query
from loometry.session import shared_dir
from loometry.sources.search import TextIndex
from loometry.sources.tables import read_table, write_table


def base(m):
    return g.unified_base(m.media_items, m.source_assets)


def links(m):
    return g.item_tags(m.media_item_tags, m.source_asset_tags)


def flat(df, *columns):
    """Arrays as text and moments as strings, so that both engines print alike."""
    out = []
    for name in columns:
        kind = dict(df.dtypes)[name]
        col = F.col(name)
        if kind == "array<string>":
            col = F.array_join(col, "|")
        elif kind == "timestamp":
            col = F.date_format(col, "yyyy-MM-dd HH:mm:ss")
        elif kind.startswith("array"):
            col = F.to_json(col)
        out.append(col.alias(name))
    return df.select(*out)


UNIFIED = """unified AS (
  SELECT id, workspace_id, user_id, created_at, 'media_item' AS item_type, status, gcs_uris, thumbnail_uris, deleted_at,
    model, prompt, mime_type, aspect_ratio, generation_time, NULL AS original_filename, NULL AS asset_type FROM media_items
  UNION ALL
  SELECT id, workspace_id, user_id, created_at, 'source_asset', 'completed', [gcs_uri],
    CASE WHEN thumbnail_gcs_uri IS NOT NULL THEN [thumbnail_gcs_uri] ELSE [] END, deleted_at,
    NULL, NULL, mime_type, aspect_ratio, NULL, original_filename, asset_type FROM source_assets)"""
LINKS = """links AS (SELECT 'media_item' AS item_type, media_item_id AS item_id, tag_id FROM media_item_tags
  UNION ALL SELECT 'source_asset', source_asset_id, tag_id FROM source_asset_tags)"""
TAG_LIST = """(SELECT string_agg(t.id || ':' || t.name || ':' || t.color || ':' || t.workspace_id, '|' ORDER BY t.id)
  FROM links k JOIN tags t ON t.id = k.tag_id WHERE k.item_id = {0}.id AND k.item_type = {0}.item_type)"""
TS = "strftime({0}, '%Y-%m-%d %H:%M:%S')"
ROW = f"id, workspace_id, user_id, {TS.format('created_at')} AS created_at, item_type, status, array_to_string(gcs_uris, '|') AS gcs_uris"
ROW_COLUMNS = ("id", "workspace_id", "user_id", "created_at", "item_type", "status", "gcs_uris")


def tag_text(df):
    line = F.transform("tags", lambda t: F.concat_ws(":", t["id"], t["name"], t["color"], t["workspace_id"]))
    return df.withColumn("tags", F.when(F.col("tags").isNotNull(), F.array_join(line, "|")))


@query("u1_unified_base", f"""
WITH {UNIFIED} SELECT {ROW}, array_to_string(thumbnail_uris, '|') AS thumbnail_uris, coalesce(original_filename, prompt) AS title,
  mime_type LIKE 'video%' AS is_video, mime_type LIKE 'audio%' AS is_audio, mime_type FROM unified
""")
def u1(m):
    df = base(m).withColumn("title", F.coalesce("original_filename", "prompt"))
    return flat(df, *ROW_COLUMNS, "thumbnail_uris", "title", "is_video", "is_audio", "mime_type")


@query("j1_unified_view", f"""
WITH {UNIFIED} SELECT u.id, u.item_type, w.name AS workspace_name, p.email AS user_email, p.picture AS user_picture
FROM unified u LEFT JOIN workspaces w ON w.id = u.workspace_id LEFT JOIN users p ON p.id = u.user_id
""")
def j1(m):
    df = g.enrich(base(m), links(m), m.tags, m.workspaces, m.users)
    return df.select("id", "item_type", "workspace_name", "user_email", "user_picture")


@query("j2_item_tags", f"WITH {LINKS}, {UNIFIED} SELECT u.id, u.item_type, {TAG_LIST.format('u')} AS tags FROM unified u")
def j2(m):
    lists = g.tag_lists(links(m), m.tags, ["item_type", "item_id"]).withColumnRenamed("item_id", "id")
    return tag_text(base(m).select("id", "item_type").join(lists, ["id", "item_type"], "left"))


@query("a10_tags_per_item", f"""
WITH {LINKS} SELECT item_type, item_id, string_agg(t.name, ',' ORDER BY t.id) AS names, count(*) AS n
FROM links JOIN tags t ON t.id = tag_id GROUP BY 1, 2
""")
def a10(m):
    lists = g.tag_lists(links(m), m.tags, ["item_type", "item_id"])
    return lists.select(
        "item_type", "item_id", F.array_join(F.transform("tags", lambda t: t["name"]), ",").alias("names"),
        F.array_size("tags").cast("long").alias("n"),
    )


@query("f3_moment_range", f"""
WITH {UNIFIED} SELECT {ROW} FROM unified WHERE created_at >= TIMESTAMP '1996-03-01 06:00:00' AND created_at < TIMESTAMP '1997-02-01 12:00:00' + INTERVAL 1 DAY
""")
def f3(m):
    return flat(base(m).filter(moment_range(F.col("created_at"), "1996-03-01 06:00:00", "1997-02-01 12:00:00")), *ROW_COLUMNS)


@query("f4_mime_wildcard", f"WITH {UNIFIED} SELECT id, item_type, mime_type FROM unified WHERE mime_type LIKE 'image/%' OR mime_type = 'video/mp4'")
def f4(m):
    mime = F.col("mime_type")
    return base(m).filter(mime_matches(mime, "image/*") | mime_matches(mime, "video/mp4")).select("id", "item_type", "mime_type")


@query("f5_json_field", f"WITH {UNIFIED} SELECT id, item_type, model FROM unified WHERE model = 'model-1'")
def f5(m):
    # Through the JSON form of the row; the plain column gives the same rows.
    docs = g.metadata_json(base(m))
    model = F.get_json_object("metadata", "$.model")
    return docs.filter(model == "model-1").select("id", "item_type", model.alias("model"))


@query("f6_multi_field_search", f"""
WITH {UNIFIED} SELECT id, item_type, coalesce(prompt, original_filename) AS title FROM unified
WHERE coalesce(prompt, '') ILIKE '%HIGH_scene 1%' OR coalesce(model, '') ILIKE '%HIGH_scene 1%' OR coalesce(original_filename, '') ILIKE '%HIGH_scene 1%'
  OR coalesce(prompt, '') ILIKE '%ring%' OR coalesce(model, '') ILIKE '%ring%' OR coalesce(original_filename, '') ILIKE '%ring%'
""")
def f6(m):
    fields = [F.col("prompt"), F.col("model"), F.col("original_filename")]
    found = base(m).filter(any_contains_ci(fields, "HIGH_scene 1") | any_contains_ci(fields, "ring"))
    return found.select("id", "item_type", F.coalesce("prompt", "original_filename").alias("title"))


@query("f6_indexed_search", f"""
WITH {UNIFIED} SELECT id, item_type, coalesce(prompt, original_filename) AS title FROM unified
WHERE coalesce(prompt, '') ILIKE '%HIGH_scene 1%' OR coalesce(model, '') ILIKE '%HIGH_scene 1%' OR coalesce(original_filename, '') ILIKE '%HIGH_scene 1%'
  OR coalesce(prompt, '') ILIKE '%ring%' OR coalesce(model, '') ILIKE '%ring%' OR coalesce(original_filename, '') ILIKE '%ring%'
""")
def f6_indexed(m):
    """The search of ``f6_multi_field_search`` by postings."""
    fields = ["prompt", "model", "original_filename"]
    items = base(m).select("id", "item_type", *fields)
    index = TextIndex.create(items, shared_dir(m.spark, "search"), ["id", "item_type"], fields)
    found = index.search("HIGH_scene 1").unionByName(index.search("ring")).dropDuplicates(["id", "item_type"])
    return found.select("id", "item_type", F.coalesce("prompt", "original_filename").alias("title"))


@query("f9_indexed_texts", "SELECT doc_id, 'phrase' AS kind FROM documents WHERE text ILIKE '%LARGE_text%' UNION ALL SELECT doc_id, 'letters' FROM documents WHERE text ILIKE '%z_z%'")
def f9_indexed(m):
    """Whole texts by postings; the second pattern has no three letters in a row."""
    index = TextIndex.create(m.raw("documents").select("doc_id", "text"), shared_dir(m.spark, "search"), ["doc_id"], ["text"])
    named = [index.search(p).select("doc_id", F.lit(kind).alias("kind")) for p, kind in (("LARGE_text", "phrase"), ("z_z", "letters"))]
    return named[0].unionByName(named[1])


@query("f7_has_all_tags", f"""
WITH {LINKS}, {UNIFIED}, named AS (SELECT item_type, item_id, list(DISTINCT name) AS names FROM links JOIN tags t ON t.id = tag_id GROUP BY 1, 2)
SELECT u.id, u.item_type FROM unified u JOIN named n ON n.item_id = u.id AND n.item_type = u.item_type
WHERE list_contains(names, 'tag1') AND list_contains(names, 'tag4')
""")
def f7(m):
    return g.with_all_tags(base(m), links(m), m.tags, ["tag1", "tag4"], ["item_type"]).select("id", "item_type")


@query("f8_array_contains", "SELECT id, email FROM users WHERE deleted_at IS NULL AND list_contains(roles, 'admin')")
def f8(m):
    return g.search_users(m.users, role="admin").select("id", "email")


@query("f8_template_tags", """
SELECT id, name, tags::VARCHAR AS tags FROM media_templates WHERE list_contains(tags, 'ring')
""")
def f8_templates(m):
    shown = F.concat(F.lit("["), F.array_join("tags", ", "), F.lit("]")).alias("tags")
    return g.search_templates(m.media_templates, tag="ring").select("id", "name", shown)


@query("f9_contains_ci", "SELECT id, email FROM users WHERE email ILIKE '%R1_@EX%'")
def f9(m):
    return g.search_users(m.users, email="R1_@EX", include_deleted=True).select("id", "email")


@query("f10_prefix_search", "SELECT id, original_filename FROM source_assets WHERE deleted_at IS NULL AND original_filename LIKE 'small_ring%'")
def f10(m):
    return g.search_assets(m.source_assets, filename_prefix="small_ring").select("id", "original_filename")


@query("f11_equality_set", """
SELECT id, scope, asset_type, mime_type FROM source_assets WHERE deleted_at IS NULL AND scope = 'private' AND asset_type = 'vto_top' AND mime_type LIKE 'image/%'
""")
def f11(m):
    found = g.search_assets(m.source_assets, scope="private", asset_type="vto_top", mime_type="image/*")
    return found.select("id", "scope", "asset_type", "mime_type")


@query("f11_template_search", """
SELECT id, industry, brand, 'page' AS kind, (SELECT count(*) FROM media_templates WHERE industry = 'ECONOMY' AND brand = 'Brand#2' AND mime_type = 'image/png') AS total FROM (
  SELECT * FROM media_templates WHERE industry = 'ECONOMY' AND brand = 'Brand#2' AND mime_type = 'image/png' ORDER BY created_at DESC, id DESC LIMIT 12 OFFSET 3)
""")
def f11_templates(m):
    found = g.template_page(m.media_templates, 12, 3, industry="ECONOMY", brand="Brand#2", mime_type="image/png")
    return found.data.select("id", "industry", "brand", F.lit("page").alias("kind"), F.lit(found.count).cast("long").alias("total"))


@query("f12_key_list", """
SELECT id, language, source FROM glossary_terms WHERE language IN ('NL', 'FR', 'NO')
UNION ALL SELECT id, 'member', name FROM users WHERE id IN (SELECT owner_id FROM workspaces)
""")
def f12(m):
    terms = g.by_keys(m.glossary_terms, "language", ["NL", "FR", "NO"]).select("id", "language", "source")
    owners = g.by_keys(m.users, "id", m.workspaces.select("owner_id"))
    nothing = g.by_keys(m.glossary_terms, "language", []).select("id", "language", "source")
    return terms.unionByName(owners.select("id", F.lit("member").alias("language"), F.col("name").alias("source"))).unionByName(nothing)


@query("f12_clustered_lookup", """
SELECT o_orderkey, o_custkey, 'order' AS by FROM orders WHERE o_orderkey IN (1, 7, 300, 999, 5000, 123456)
UNION ALL SELECT o_orderkey, o_custkey, 'customer' FROM orders WHERE o_custkey IN (7, 70, 700)
""")
def f12_clustered(m):
    """Listed keys in a table stored by customer, with a Bloom filter on its order keys."""
    path = shared_dir(m.spark, "orders")
    write_table(m.raw("orders"), path, by=["o_custkey"], lookups=["o_orderkey"])
    orders = read_table(m.spark, path).select("o_orderkey", "o_custkey")
    listed = g.by_keys(orders, "o_orderkey", [1, 7, 300, 999, 5000, 123456]).withColumn("by", F.lit("order"))
    return listed.unionByName(g.by_keys(orders, "o_custkey", [7, 70, 700]).withColumn("by", F.lit("customer")))


@query("f13_visibility", """
SELECT id, scope, asset_type FROM source_assets WHERE deleted_at IS NULL
AND (scope = 'system' OR (user_id = 7 AND scope = 'private')) AND asset_type IN ('vto_top', 'vto_shoe')
""")
def f13(m):
    return g.visible_assets(m.source_assets, 7, ["vto_top", "vto_shoe"]).select("id", "scope", "asset_type")


@query("f14_role_forced", f"WITH {UNIFIED} SELECT {ROW} FROM unified WHERE deleted_at IS NULL AND workspace_id = 3 AND status = 'completed'")
def f14(m):
    search = g.Search(workspace_id=3, status="failed").for_role(is_admin=False)
    return flat(g.filter_gallery(base(m), search), *ROW_COLUMNS)


@query("f18_may_act", f"""
WITH {UNIFIED} SELECT r.type, r.id FROM (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'media_item' ELSE 'source_asset' END AS type FROM orders) r
WHERE EXISTS (SELECT 1 FROM unified u WHERE u.item_type = r.type AND u.id = r.id AND u.deleted_at IS NULL AND u.workspace_id = 5 AND u.user_id = 5)
""")
def f18(m):
    key = F.col("o_orderkey")
    requests = m.raw("orders").select(key.alias("id"), F.when(key % 2 == 0, "media_item").otherwise("source_asset").alias("type"))
    return g.may_act(requests, base(m), 5, 5, is_admin=False).select("type", "id")


REQUESTS = """requests AS (SELECT DISTINCT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'media_item' ELSE 'source_asset' END AS type FROM orders),
found AS (SELECT r.type AS wanted_type, r.id AS wanted_id, u.* FROM requests r LEFT JOIN unified u ON u.item_type = r.type AND u.id = r.id AND u.deleted_at IS NULL)"""


def bulk_requests(m):
    key = F.col("o_orderkey")
    return m.raw("orders").select(key.alias("id"), F.when(key % 2 == 0, "media_item").otherwise("source_asset").alias("type"))


@query("f18_bulk_counts", f"""
WITH {UNIFIED}, {REQUESTS} SELECT count(*) FILTER (WHERE o = 'done') AS done, count(*) FILTER (WHERE o <> 'done') AS skipped, count(*) FILTER (WHERE o = 'missing') AS missing,
  count(*) FILTER (WHERE o = 'elsewhere') AS elsewhere, count(*) FILTER (WHERE o = 'not_owner') AS not_owner
FROM (SELECT CASE WHEN id IS NULL THEN 'missing' WHEN workspace_id IS DISTINCT FROM 5 THEN 'elsewhere' WHEN user_id IS DISTINCT FROM 5 THEN 'not_owner' ELSE 'done' END AS o FROM found)
""")
def f18_counts(m):
    return g.bulk_counts(g.bulk_outcome(bulk_requests(m), base(m), 5, 5, is_admin=False))


@query("s18_chosen_downloads", f"""
WITH {UNIFIED}, {REQUESTS},
allowed AS (SELECT id FROM workspaces WHERE scope = 'public' OR owner_id = 7 UNION SELECT workspace_id FROM workspace_members WHERE user_id = 7)
SELECT item_type, id, gcs_uris[1] AS gcs_uri, CASE WHEN item_type = 'media_item'
  THEN 'media_' || id || '.' || CASE mime_type WHEN 'image/jpeg' THEN 'jpg' WHEN 'image/png' THEN 'png' WHEN 'video/mp4' THEN 'mp4'
    WHEN 'audio/mpeg' THEN 'mp3' WHEN 'application/pdf' THEN 'pdf' ELSE 'bin' END
  ELSE 'asset_' || id || '.' || CASE WHEN gcs_uris[1] LIKE '%.%' THEN string_split(gcs_uris[1], '.')[-1] ELSE 'bin' END END AS filename
FROM found WHERE id IS NOT NULL AND workspace_id IN (SELECT id FROM allowed) AND coalesce(gcs_uris[1], '') <> ''
""")
def s18_chosen(m):
    return g.chosen_downloads(bulk_requests(m), base(m), m.workspaces, m.workspace_members, 7, is_admin=False)


@query("f19_try_on_buckets", """
SELECT id, CASE asset_type WHEN 'vto_top' THEN 'tops' WHEN 'vto_bottom' THEN 'bottoms' WHEN 'vto_dress' THEN 'dresses'
  WHEN 'vto_shoe' THEN 'shoes' WHEN 'vto_person_male' THEN 'male_models' ELSE 'female_models' END AS bucket
FROM source_assets WHERE deleted_at IS NULL AND (scope = 'system' OR (user_id = 8 AND scope = 'private'))
  AND asset_type IN ('vto_top', 'vto_bottom', 'vto_dress', 'vto_shoe', 'vto_person_male', 'vto_person_female')
""")
def f19(m):
    return g.try_on_assets(m.source_assets, 8).select("id", "bucket")


@query("j3_junction_join", """
SELECT media_item_id, tag_id, name, color, t.workspace_id FROM media_item_tags JOIN tags t ON t.id = tag_id
""")
def j3(m):
    return g.tags_of(m.media_item_tags, m.tags, "media_item_id")


@query("j3_member_workspaces", "SELECT user_id, w.id, w.name, w.scope FROM workspace_members k JOIN workspaces w ON w.id = k.workspace_id")
def j3b(m):
    return g.workspaces_of_members(m.workspaces, m.workspace_members).select("user_id", "id", "name", "scope")


@query("j4_exists_per_tag", """
SELECT id, original_filename FROM source_assets a WHERE deleted_at IS NULL
AND EXISTS (SELECT 1 FROM source_asset_tags k JOIN tags t ON t.id = k.tag_id WHERE k.source_asset_id = a.id AND t.name = 'tag2')
AND EXISTS (SELECT 1 FROM source_asset_tags k JOIN tags t ON t.id = k.tag_id WHERE k.source_asset_id = a.id AND t.name = 'tag5')
""")
def j4(m):
    return g.search_assets(m.source_assets, names=["tag2", "tag5"], links=m.source_asset_tags, tags=m.tags).select("id", "original_filename")


@query("j6_is_member", """
SELECT i.workspace_id, i.user_id, EXISTS (SELECT 1 FROM workspace_members k WHERE k.workspace_id = i.workspace_id AND k.user_id = i.user_id) AS is_member
FROM (SELECT DISTINCT workspace_id, user_id FROM media_items) i
""")
def j6(m):
    return g.membership_flags(m.media_items.select("workspace_id", "user_id").distinct(), m.workspace_members)


@query("u2_visible_workspaces", """
SELECT id, name, scope FROM workspaces WHERE scope = 'public' OR id IN (SELECT workspace_id FROM workspace_members WHERE user_id = 11)
""")
def u2(m):
    return g.visible_workspaces(m.workspaces, m.workspace_members, 11).select("id", "name", "scope")


@query("l1_gallery_page", f"""
WITH {LINKS}, {UNIFIED}, p AS (SELECT * FROM unified WHERE deleted_at IS NULL AND mime_type LIKE 'image/%'
  ORDER BY created_at DESC NULLS FIRST, id DESC, item_type LIMIT 50 OFFSET 100)
SELECT p.id, p.item_type, {TS.format('p.created_at')} AS created_at, w.name AS workspace_name, u.email AS user_email, {TAG_LIST.format('p')} AS tags
FROM p LEFT JOIN workspaces w ON w.id = p.workspace_id LEFT JOIN users u ON u.id = p.user_id
""")
def l1(m):
    search = g.Search(mime_type="image/*", limit=50, offset=100)
    rows = g.search_rows(base(m), search, links(m), m.tags, m.workspaces, m.users)
    return flat(tag_text(rows), "id", "item_type", "created_at", "workspace_name", "user_email", "tags")


@query("l2_asset_page", f"""
SELECT id, original_filename, {TS.format('created_at')} AS created_at FROM source_assets WHERE deleted_at IS NULL ORDER BY created_at DESC, id DESC LIMIT 40 OFFSET 40
""")
def l2(m):
    rows = page_rows(g.search_assets(m.source_assets), [F.col("created_at").desc(), F.col("id").desc()], 40, 40)
    return flat(rows, "id", "original_filename", "created_at")


@query("l5_recent_tags", f"""
SELECT id, name, {TS.format('updated_at')} AS updated_at FROM tags WHERE workspace_id = 4 AND name ILIKE '%TAG%' ORDER BY updated_at DESC, id LIMIT 10
""")
def l5(m):
    found = g.search_tags(m.tags, 4, "TAG")
    return flat(page_rows(found, [F.col("updated_at").desc(), F.col("id")], 10), "id", "name", "updated_at")


@query("a9_page_count", f"""
WITH {UNIFIED} SELECT item_type, count(*) AS count, ((count(*) + 11) // 12)::BIGINT AS total_pages FROM unified WHERE deleted_at IS NULL AND status = 'completed' GROUP BY 1
""")
def a9(m):
    found = g.filter_gallery(base(m), g.Search(status="completed"))
    return found.groupBy("item_type").agg(F.count(F.lit(1)).alias("count")).withColumn(
        "total_pages", F.ceil(F.col("count") / 12)
    )


@query("a16_tags_per_workspace", "SELECT workspace_id, count(id) AS count FROM tags GROUP BY 1")
def a16(m):
    return m.tags.groupBy("workspace_id").agg(F.count("id").alias("count"))


@query("s18_download_manifest", f"""
WITH {UNIFIED} SELECT item_type, id, gcs_uris[1] AS gcs_uri, CASE WHEN item_type = 'media_item'
  THEN 'media_' || id || '.' || CASE mime_type WHEN 'image/jpeg' THEN 'jpg' WHEN 'image/png' THEN 'png' WHEN 'video/mp4' THEN 'mp4'
    WHEN 'audio/mpeg' THEN 'mp3' WHEN 'application/pdf' THEN 'pdf' ELSE 'bin' END
  ELSE 'asset_' || id || '.' || CASE WHEN gcs_uris[1] LIKE '%.%' THEN string_split(gcs_uris[1], '.')[-1] ELSE 'bin' END END AS filename
FROM unified WHERE deleted_at IS NULL AND coalesce(gcs_uris[1], '') <> ''
""")
def s18(m):
    return g.download_manifest(base(m))


@query("s17_asset_type_from_filename", """
SELECT id, asset_type || '_' || id || '.png' AS filename, asset_type AS found FROM source_assets WHERE asset_type <> 'generic_image' OR id % 2 = 1
""")
def s17(m):
    name = F.concat(
        F.when((F.col("asset_type") == "generic_image") & (F.col("id") % 2 == 0), "other").otherwise(F.col("asset_type")),
        F.lit("_"), F.col("id").cast("string"), F.lit(".png"),
    )
    named = m.source_assets.select("id", name.alias("filename"))
    return named.withColumn("found", asset_type_from_filename(F.col("filename"))).filter(F.col("found").isNotNull())


RATIOS = ["9:16", "16:9", "1:1", "3:4", "4:3", "2:3", "3:2", "4:5", "5:4", "21:9", "1:4", "4:1", "1:8", "8:1"]
RATIO_ROWS = ", ".join(f"({i}, '{r}', {r.split(':')[0]}::DOUBLE / {r.split(':')[1]})" for i, r in enumerate(RATIOS))


@query("j12_nearest_ratio", f"""
WITH ratios AS (SELECT * FROM (VALUES {RATIO_ROWS}) v(ord, ratio, value)),
near AS (SELECT a.id, min_by(ratio, abs(value - width::DOUBLE / height) * 1e6 + ord * 1e-6) AS ratio, min(abs(value - width::DOUBLE / height)) AS diff
  FROM source_assets a, ratios WHERE height > 0 GROUP BY a.id)
SELECT a.id, CASE WHEN diff > 0.02 THEN 'other' ELSE ratio END AS ratio FROM source_assets a LEFT JOIN near n ON n.id = a.id
""")
def j12(m):
    return m.source_assets.select("id", nearest_ratio(F.col("width"), F.col("height")).alias("ratio"))


@query("j11_asset_links", """
SELECT l.media_item_id AS id, string_agg(a.id || ' ' || a.gcs_uri || ' ' || a.mime_type || ' ' || role || ' ' || coalesce(a.thumbnail_gcs_uri, ''), '|' ORDER BY pos) AS assets
FROM media_links l JOIN source_assets a ON a.id = l.asset_id WHERE a.deleted_at IS NULL
  AND l.media_item_id IN (SELECT id FROM media_items WHERE deleted_at IS NULL) GROUP BY 1
""")
def j11(m):
    items = m.media_items_linked.filter(not_deleted())
    out = enrich_asset_links(items.select("id", "source_assets"), m.source_assets)
    line = F.transform("source_assets", lambda a: F.concat_ws(
        " ", a["asset_id"], a["gcs_uri"], a["mime_type"], a["role"], F.coalesce(a["thumbnail_gcs_uri"], F.lit(""))))
    return out.filter(F.array_size("source_assets") > 0).select("id", F.array_join(line, "|").alias("assets"))


@query("j10_parent_links", """
SELECT l.media_item_id AS id, p.id AS parent_id, media_index, p.gcs_uris[media_index + 1] AS gcs_uri,
  p.thumbnail_uris[media_index + 1] AS thumbnail_uri, p.mime_type, role
FROM media_links l JOIN media_items p ON p.id = l.parent_id
WHERE p.deleted_at IS NULL AND media_index >= 0 AND media_index < len(p.gcs_uris)
  AND l.media_item_id IN (SELECT id FROM media_items WHERE deleted_at IS NULL)
""")
def j10(m):
    items = m.media_items_linked.filter(not_deleted())
    return parent_links(items.select("id", "source_media_items"), m.media_items)


@query("w17_time_buckets", f"""
WITH {UNIFIED}, d AS (SELECT id, item_type, created_at::DATE AS d, created_at::DATE - dayofweek(created_at)::INT AS s FROM unified WHERE deleted_at IS NULL)
SELECT CASE WHEN d = DATE '1998-03-04' THEN 'Today' WHEN d = DATE '1998-03-03' THEN 'Yesterday'
  WHEN DATE '1998-03-04' - d <= 60 THEN strftime(s, '%b %-d') || ' - ' || CASE WHEN month(s) = month(s + 6) THEN strftime(s + 6, '%-d') ELSE strftime(s + 6, '%b %-d') END
  ELSE strftime(d, '%B %Y') END AS bucket, count(*) AS items FROM d GROUP BY 1
""")
def w17(m):
    found = base(m).filter(not_deleted())
    bucket = time_bucket(F.col("created_at"), F.lit("1998-03-04").cast("timestamp"))
    return found.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("items"))


@query("l1_deep_page", f"""
WITH {UNIFIED} SELECT id, item_type, {TS.format('created_at')} AS created_at FROM unified WHERE deleted_at IS NULL
ORDER BY unified.created_at DESC NULLS FIRST, id DESC, item_type LIMIT 100 OFFSET (SELECT count(*) // 2 FROM unified WHERE deleted_at IS NULL)
""")
def l1_deep(m):
    found = g.filter_gallery(base(m), g.Search())
    rows = deep_page_rows(found, F.unix_micros("created_at"), g.newest_first(), 100, found.count() // 2, deep=1000)
    return flat(rows, "id", "item_type", "created_at")
