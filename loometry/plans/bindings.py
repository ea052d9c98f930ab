"""The analytics model on top of the provided star-schema tables.

Each model table is written twice: as a DataFrame function (what runs on
Spark) and as SQL text in ``CTE`` (what the comparison engine runs). Both read
whole tables. Nothing here collects or samples.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loometry import fixed
from loometry.functions.review import content_hash
from loometry.session import cut_lineage

L = F.lit

CTE: dict[str, str] = {}


def _case(col: str, pairs: dict, default: str) -> str:
    whens = " ".join(f"WHEN {k!r} THEN {v!r}" for k, v in pairs.items())
    return f"CASE {col} {whens} ELSE {default!r} END"


def _choose(col, pairs: dict, default: str):
    out = None
    for key, value in pairs.items():
        out = F.when(col == key, value) if out is None else out.when(col == key, value)
    return out.otherwise(default)


# Fixed values of the bindings.
MIME_BY_PRIORITY = {"1": "image/png", "2": "image/jpeg", "3": "video/mp4", "4": "audio/wav"}
STATUS_BY_FLAG = {"F": "completed", "O": "processing"}
TYPE_BY_PART = {
    "STANDARD": "vto_top", "PROMO": "vto_bottom", "LARGE": "vto_dress",
    "SMALL": "vto_shoe", "MEDIUM": "vto_person_male",
}
MARKET_LIST = fixed.TARGET_MARKETS
MARKETS_SQL = "[" + ", ".join(f"'{m}'" for m in MARKET_LIST) + "]"


class Model:
    """Model tables for one data folder. Attributes are cached DataFrames
    (plans, not data)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cache
    def raw(self, name: str) -> DataFrame:
        path = f"{self.sf_dir}/{name}.parquet"
        return self.spark.read.schema(self.schema(name)).parquet(path)

    def stream(self, name: str) -> DataFrame:
        """The same table as a file stream."""
        return (
            self.spark.readStream.schema(self.schema(name))
            .option("pathGlobFilter", f"{name}.parquet").parquet(self.sf_dir)
        )

    @cache
    def schema(self, name: str) -> T.StructType:
        found = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet").schema
        # Zone-less timestamps are read as UTC instants. Doing it in the reader
        # keeps date filters on plain columns, so they reach the scan.
        return T.StructType([
            T.StructField(f.name, T.TimestampType() if f.dataType == T.TimestampNTZType() else f.dataType)
            for f in found
        ])

    def __getattr__(self, name: str) -> DataFrame:
        build = TABLES.get(name)
        if build is None:
            raise AttributeError(name)
        df = build(self)
        self.__dict__[name] = df
        return df


def _market(col):
    markets = F.array(*[L(m) for m in MARKET_LIST])
    return F.get(markets, (col % len(MARKET_LIST)).cast("int"))


def _market_sql(col: str) -> str:
    return f"{MARKETS_SQL}[({col} % {len(MARKET_LIST)}) + 1]"


# --- media ---------------------------------------------------------------

def media_items(m: Model) -> DataFrame:
    # Distinct values combine before the shuffle, so an order that holds a third of
    # all lines costs each task one small set.
    lines = m.raw("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_linenumber")).alias("lines"))
    key = F.col("o_orderkey")
    stem = F.concat(L("gs://media/"), key.cast("string"), L("/"))
    orders = m.raw("orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    digit = F.substring("o_orderpriority", 1, 1)
    return orders.select(
        key.alias("id"),
        (F.col("o_custkey") % 26).alias("workspace_id"),
        F.col("o_custkey").alias("user_id"),
        F.concat(L("user"), F.col("o_custkey").cast("string"), L("@example.com")).alias("user_email"),
        _choose(digit, MIME_BY_PRIORITY, "application/pdf").alias("mime_type"),
        F.concat(L("model-"), (key % 3).cast("string")).alias("model"),
        F.concat(F.lower("o_orderpriority"), L(" scene "), (key % 100).cast("string")).alias("prompt"),
        F.when(key % 5 == 0, F.concat(L("original "), (key % 100).cast("string"))).alias("original_prompt"),
        F.when(key % 7 == 0, L("blurry")).alias("negative_prompt"),
        L("16:9").alias("aspect_ratio"),
        F.when(key % 2 == 0, L("modern")).otherwise(L("vintage")).alias("style"),
        L("studio").alias("lighting"),
        F.array_size("lines").cast("long").alias("num_media"),
        F.col("o_totalprice").alias("generation_time"),
        _choose(F.col("o_orderstatus"), STATUS_BY_FLAG, "failed").alias("status"),
        F.transform("lines", lambda n: F.concat(stem, n.cast("string"), L(".bin"))).alias("gcs_uris"),
        F.transform("lines", lambda n: F.concat(stem, n.cast("string"), L("_t.png"))).alias("thumbnail_uris"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderdate").alias("updated_at"),
        F.when(key % 17 == 0, F.col("o_orderdate")).alias("deleted_at"),
        F.when(key % 17 == 0, L(1).cast("long")).alias("deleted_by"),
    )


CTE["media_items"] = f"""
SELECT o_orderkey AS id, o_custkey % 26 AS workspace_id, o_custkey AS user_id,
  'user' || o_custkey || '@example.com' AS user_email,
  {_case("left(o_orderpriority, 1)", MIME_BY_PRIORITY, "application/pdf")} AS mime_type,
  'model-' || (o_orderkey % 3) AS model,
  lower(o_orderpriority) || ' scene ' || (o_orderkey % 100) AS prompt,
  CASE WHEN o_orderkey % 5 = 0 THEN 'original ' || (o_orderkey % 100) END AS original_prompt,
  CASE WHEN o_orderkey % 7 = 0 THEN 'blurry' END AS negative_prompt,
  '16:9' AS aspect_ratio,
  CASE WHEN o_orderkey % 2 = 0 THEN 'modern' ELSE 'vintage' END AS style,
  'studio' AS lighting,
  len(lines)::BIGINT AS num_media,
  o_totalprice AS generation_time,
  {_case("o_orderstatus", STATUS_BY_FLAG, "failed")} AS status,
  list_transform(lines, lambda n: 'gs://media/' || o_orderkey || '/' || n || '.bin') AS gcs_uris,
  list_transform(lines, lambda n: 'gs://media/' || o_orderkey || '/' || n || '_t.png') AS thumbnail_uris,
  o_orderdate AS created_at, o_orderdate AS updated_at,
  CASE WHEN o_orderkey % 17 = 0 THEN o_orderdate END AS deleted_at,
  CASE WHEN o_orderkey % 17 = 0 THEN 1::BIGINT END AS deleted_by
FROM orders LEFT JOIN (SELECT l_orderkey, list_sort(list(DISTINCT l_linenumber)) AS lines
  FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
"""


def media_links(m: Model) -> DataFrame:
    """One input link per (item, line): even lines point at assets, odd lines
    at parent items."""
    lines = m.raw("lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.max("l_partkey").alias("part"), F.max("l_suppkey").alias("supp")
    )
    even = F.col("l_linenumber") % 2 == 0
    return lines.select(
        F.col("l_orderkey").alias("media_item_id"),
        F.col("l_linenumber").cast("int").alias("pos"),
        F.when(even, F.col("part")).alias("asset_id"),
        F.when(~even, F.col("l_orderkey") - F.col("supp")).alias("parent_id"),
        (F.col("supp") % 9 - 1).cast("int").alias("media_index"),
        F.when(even, L("input")).otherwise(L("edit")).alias("role"),
    )


CTE["media_links"] = """
SELECT l_orderkey AS media_item_id, l_linenumber::INT AS pos,
  CASE WHEN l_linenumber % 2 = 0 THEN max(l_partkey) END AS asset_id,
  CASE WHEN l_linenumber % 2 <> 0 THEN l_orderkey - max(l_suppkey) END AS parent_id,
  (max(l_suppkey) % 9 - 1)::INT AS media_index,
  CASE WHEN l_linenumber % 2 = 0 THEN 'input' ELSE 'edit' END AS role
FROM lineitem GROUP BY l_orderkey, l_linenumber
"""


def media_items_linked(m: Model) -> DataFrame:
    """Media items with their link arrays (at most one link per line number)."""
    entry = F.struct("pos", "asset_id", "parent_id", "media_index", "role")
    links = m.media_links.groupBy("media_item_id").agg(F.sort_array(F.collect_set(entry)).alias("links"))
    return m.media_items.join(links, F.col("id") == F.col("media_item_id"), "left").select(
        *m.media_items.columns,
        F.transform(
            F.filter("links", lambda x: x["asset_id"].isNotNull()),
            lambda x: F.struct(x["asset_id"].alias("asset_id"), x["role"].alias("role")),
        ).alias("source_assets"),
        F.transform(
            F.filter("links", lambda x: x["parent_id"].isNotNull()),
            lambda x: F.struct(
                x["parent_id"].alias("media_item_id"), x["media_index"].alias("media_index"),
                x["role"].alias("role"),
            ),
        ).alias("source_media_items"),
    )


def users(m: Model) -> DataFrame:
    seg, key = F.col("c_mktsegment"), F.col("c_custkey")
    none = F.array().cast("array<string>")
    return m.raw("customer").select(
        key.alias("id"),
        F.concat(L("user"), key.cast("string"), L("@example.com")).alias("email"),
        F.when(seg == "AUTOMOBILE", F.array(L("user")))
        .when(seg == "BUILDING", F.array(L("user"), L("admin")))
        .when(seg == "FURNITURE", none)
        .when(seg == "HOUSEHOLD", F.array(L("creator"), L("user"), L("creator"))).alias("roles"),
        F.col("c_name").alias("name"),
        F.concat(L("https://pics.example.com/"), key.cast("string")).alias("picture"),
        (L("1992-01-01").cast("timestamp") + F.make_dt_interval((key % 3650).cast("int"))).alias("created_at"),
        F.when(key % 19 == 0, L("2002-01-01").cast("timestamp")).alias("deleted_at"),
    )


CTE["users"] = """
SELECT c_custkey AS id, 'user' || c_custkey || '@example.com' AS email,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN ['user'] WHEN 'BUILDING' THEN ['user', 'admin']
    WHEN 'FURNITURE' THEN []::VARCHAR[] WHEN 'HOUSEHOLD' THEN ['creator', 'user', 'creator'] END AS roles,
  c_name AS name, 'https://pics.example.com/' || c_custkey AS picture,
  TIMESTAMP '1992-01-01' + to_days((c_custkey % 3650)::INT) AS created_at,
  CASE WHEN c_custkey % 19 = 0 THEN TIMESTAMP '2002-01-01' END AS deleted_at
FROM customer
"""


def workspaces(m: Model) -> DataFrame:
    key = F.col("n_nationkey").cast("long")
    return m.raw("nation").select(
        key.alias("id"), F.col("n_name").alias("name"), key.alias("owner_id"),
        F.when(F.col("n_regionkey") == 0, "public").otherwise("private").alias("scope"),
        (L("1992-01-01").cast("timestamp") + F.make_dt_interval((key * 150).cast("int"))).alias("created_at"),
    )


CTE["workspaces"] = """
SELECT n_nationkey::BIGINT AS id, n_name AS name, n_nationkey::BIGINT AS owner_id,
  CASE WHEN n_regionkey = 0 THEN 'public' ELSE 'private' END AS scope,
  TIMESTAMP '1992-01-01' + to_days((n_nationkey * 150)::INT) AS created_at
FROM nation
"""


def workspace_members(m: Model) -> DataFrame:
    roles = F.array(L("viewer"), L("editor"), L("admin"), L("owner"))
    return m.raw("customer").select(
        F.col("c_nationkey").cast("long").alias("workspace_id"),
        F.col("c_custkey").alias("user_id"),
        F.get(roles, (F.col("c_custkey") % 4).cast("int")).alias("role"),
    )


CTE["workspace_members"] = """
SELECT c_nationkey::BIGINT AS workspace_id, c_custkey AS user_id,
  ['viewer', 'editor', 'admin', 'owner'][(c_custkey % 4) + 1] AS role FROM customer
"""


def source_assets(m: Model) -> DataFrame:
    return assets_of(m.raw("part"))


def assets_of(part: DataFrame) -> DataFrame:
    """Uploaded assets from part rows (a table or a stream)."""
    key, size = F.col("p_partkey"), F.col("p_size").cast("long")
    ident = key.cast("string")
    return part.select(
        key.alias("id"),
        (key % 25).alias("workspace_id"),
        size.alias("user_id"),
        F.concat(L("gs://assets/"), ident, F.when(size % 6 == 0, L("")).otherwise(L(".jpg"))).alias("gcs_uri"),
        F.concat(F.replace(F.col("p_name"), L(" "), L("_")), L("_"), ident, L(".jpg")).alias("original_filename"),
        F.when(size % 4 == 0, "video/mp4").when(size % 4 == 1, "audio/mpeg")
        .otherwise("image/jpeg").alias("mime_type"),
        F.when(size % 2 == 0, "1:1").otherwise("4:3").alias("aspect_ratio"),
        F.sha2(F.concat_ws("|", "p_brand", "p_type"), 256).alias("file_hash"),
        F.when(size % 5 == 0, "system").otherwise("private").alias("scope"),
        _choose(F.col("p_type"), TYPE_BY_PART, "generic_image").alias("asset_type"),
        F.when(key % 3 == 0, F.concat(L("gs://assets/"), ident, L("_t.jpg"))).alias("thumbnail_gcs_uri"),
        (L("1995-01-01").cast("timestamp") + F.make_dt_interval((key % 1000).cast("int"))).alias("created_at"),
        F.when(key % 13 == 0, L("2002-01-01").cast("timestamp")).alias("deleted_at"),
        (size * 40).cast("int").alias("width"),
        ((size % 8) * 120).cast("int").alias("height"),
    )


CTE["source_assets"] = f"""
SELECT p_partkey AS id, p_partkey % 25 AS workspace_id, p_size::BIGINT AS user_id,
  'gs://assets/' || p_partkey || CASE WHEN p_size % 6 = 0 THEN '' ELSE '.jpg' END AS gcs_uri,
  replace(p_name, ' ', '_') || '_' || p_partkey || '.jpg' AS original_filename,
  CASE WHEN p_size % 4 = 0 THEN 'video/mp4' WHEN p_size % 4 = 1 THEN 'audio/mpeg' ELSE 'image/jpeg' END AS mime_type,
  CASE WHEN p_size % 2 = 0 THEN '1:1' ELSE '4:3' END AS aspect_ratio,
  sha256(p_brand || '|' || p_type) AS file_hash,
  CASE WHEN p_size % 5 = 0 THEN 'system' ELSE 'private' END AS scope,
  {_case("p_type", TYPE_BY_PART, "generic_image")} AS asset_type,
  CASE WHEN p_partkey % 3 = 0 THEN 'gs://assets/' || p_partkey || '_t.jpg' END AS thumbnail_gcs_uri,
  TIMESTAMP '1995-01-01' + to_days((p_partkey % 1000)::INT) AS created_at,
  CASE WHEN p_partkey % 13 = 0 THEN TIMESTAMP '2002-01-01' END AS deleted_at,
  (p_size * 40)::INT AS width, ((p_size % 8) * 120)::INT AS height
FROM part
"""


def tags(m: Model) -> DataFrame:
    key = F.col("s_suppkey")
    return m.raw("supplier").select(
        key.alias("id"),
        F.concat(L("tag"), (key % 10).cast("string")).alias("name"),
        F.get(F.array(*[L(c) for c in fixed.TAG_COLORS]), (key % len(fixed.TAG_COLORS)).cast("int")).alias("color"),
        F.col("s_nationkey").cast("long").alias("workspace_id"),
        (key % 7).alias("user_id"),
        (L("1996-01-01").cast("timestamp") + F.make_dt_interval((key * 37 % 1000).cast("int"))).alias("updated_at"),
    )


CTE["tags"] = f"""
SELECT s_suppkey AS id, 'tag' || (s_suppkey % 10) AS name,
  [{", ".join(f"'{c}'" for c in fixed.TAG_COLORS)}][(s_suppkey % {len(fixed.TAG_COLORS)}) + 1] AS color,
  s_nationkey::BIGINT AS workspace_id, s_suppkey % 7 AS user_id,
  TIMESTAMP '1996-01-01' + to_days((s_suppkey * 37 % 1000)::INT) AS updated_at
FROM supplier
"""


def media_item_tags(m: Model) -> DataFrame:
    return m.raw("lineitem").select(
        F.col("l_orderkey").alias("media_item_id"), F.col("l_suppkey").alias("tag_id")
    ).distinct()


CTE["media_item_tags"] = "SELECT DISTINCT l_orderkey AS media_item_id, l_suppkey AS tag_id FROM lineitem"


def source_asset_tags(m: Model) -> DataFrame:
    return m.raw("lineitem").select(
        F.col("l_partkey").alias("source_asset_id"), F.col("l_suppkey").alias("tag_id")
    ).distinct()


CTE["source_asset_tags"] = "SELECT DISTINCT l_partkey AS source_asset_id, l_suppkey AS tag_id FROM lineitem"


# --- localization ----------------------------------------------------------

def _with_blanks(m: Model, every: int, at: int) -> DataFrame:
    """The conversations and, beside some of their turns, further ones without text."""
    rows = m.raw("conversations").select("conv_id", "turn", "role", "text")
    blank = rows.filter(F.col("turn") % every == at).select("conv_id", (F.col("turn") + 1000).alias("turn"), "role", L("").alias("text"))
    return rows.unionByName(blank)


def _with_blanks_sql(every: int, at: int) -> str:
    return f"""(SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT conv_id, turn + 1000, role, '' FROM conversations WHERE turn % {every} = {at})"""


def segments(m: Model) -> DataFrame:
    turn = F.col("turn").cast("int")
    limit = (turn + 1) * 40
    return _with_blanks(m, 6, 5).select(
        F.col("conv_id").alias("briefing_id"),
        turn.alias("segment_index"),
        F.when(turn % 5 != 4, F.col("role")).alias("block"),
        F.concat(L("Field "), turn.cast("string")).alias("field"),
        F.concat(L("Field "), turn.cast("string"), L(" (MAX "), limit.cast("string"), L(" chars)")).alias("label"),
        F.when(turn % 3 != 2, limit).alias("char_limit"),
        "text",
    )


CTE["segments"] = f"""
SELECT conv_id AS briefing_id, turn::INT AS segment_index,
  CASE WHEN turn % 5 <> 4 THEN role END AS block, 'Field ' || turn AS field,
  'Field ' || turn || ' (MAX ' || ((turn + 1) * 40) || ' chars)' AS label,
  CASE WHEN turn % 3 <> 2 THEN ((turn + 1) * 40)::INT END AS char_limit,
  text
FROM {_with_blanks_sql(6, 5)}
"""


def translations(m: Model) -> DataFrame:
    """Two markets per briefing; the last segment is not translated."""
    first = _market(F.col("briefing_id"))
    second = _market(F.col("briefing_id") * 3 + 5)
    last = m.segments.groupBy("briefing_id").agg(F.max("segment_index").alias("_last"))
    return m.segments.join(last, "briefing_id").filter("segment_index < _last").select(
        "briefing_id", F.explode(F.array_distinct(F.array(first, second))).alias("market"),
        "segment_index", "text",
    ).select(
        "briefing_id", "market", "segment_index",
        F.concat(F.col("market"), L(": "), F.col("text")).alias("text"),
    )


CTE["translations"] = f"""
SELECT briefing_id, market, segment_index, market || ': ' || text AS text FROM (
  SELECT briefing_id, segment_index, text,
    unnest(list_distinct([{_market_sql("briefing_id")}, {_market_sql("(briefing_id * 3 + 5)")}])) AS market
  FROM segments s WHERE segment_index < (SELECT max(segment_index) FROM segments l WHERE l.briefing_id = s.briefing_id))
"""


def briefings(m: Model) -> DataFrame:
    ids = m.raw("conversations").groupBy(F.col("conv_id").alias("id")).agg(F.count(L(1)).alias("n_segments"))
    return ids.select(
        "id",
        F.concat(L("Briefing "), F.col("id").cast("string")).alias("name"),
        L("EN").alias("source_market"),
        "n_segments",
        (L("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=(F.col("id") * 7).cast("int"))).alias("created_at"),
    )


CTE["briefings"] = """
SELECT conv_id AS id, 'Briefing ' || conv_id AS name, 'EN' AS source_market, count(*) AS n_segments,
  TIMESTAMP '2024-01-01' + to_hours((conv_id * 7)::INT) AS created_at
FROM conversations GROUP BY conv_id
"""


def feedback_requests(m: Model) -> DataFrame:
    key = F.col("id")
    states = F.array(L("draft"), L("in_review"), L("done"))
    day = F.make_dt_interval
    base = L("2024-02-01").cast("timestamp")
    return m.briefings.select(
        key.alias("briefing_id"), _market(key).alias("market"),
        F.get(states, (key % 3).cast("int")).alias("review_state"),
        F.when(key % 4 != 0, F.sha2(key.cast("string"), 256)).alias("token_hash"),
        F.when(key % 5 != 0, base + day((key % 20).cast("int"))).alias("expires_at"),
        F.when(key % 6 == 0, base).alias("revoked_at"),
    )


CTE["feedback_requests"] = f"""
SELECT id AS briefing_id, {_market_sql("id")} AS market,
  ['draft', 'in_review', 'done'][(id % 3) + 1] AS review_state,
  CASE WHEN id % 4 <> 0 THEN sha256(id::VARCHAR) END AS token_hash,
  CASE WHEN id % 5 <> 0 THEN TIMESTAMP '2024-02-01' + to_days((id % 20)::INT) END AS expires_at,
  CASE WHEN id % 6 = 0 THEN TIMESTAMP '2024-02-01' END AS revoked_at
FROM briefings
"""


def tickets(m: Model) -> DataFrame:
    key = F.col("event_id")
    index = (key % 9).cast("int")
    fresh = content_hash(
        F.concat(L("Field "), index.cast("string")), F.coalesce(F.col("text"), L("")), L("")
    )
    events = m.raw("events").withColumn("segment_index", index)
    text = m.segments.select(
        F.col("briefing_id").alias("b"), F.col("segment_index").alias("i"), F.col("text")
    )
    return events.join(
        text, (F.col("user_id") == F.col("b")) & (F.col("segment_index") == F.col("i")), "left"
    ).select(
        key.alias("id"), F.col("user_id").alias("briefing_id"), _market(key).alias("market"),
        "segment_index",
        F.when(key % 3 == 1, fresh).when(key % 3 == 2, L("stale")).alias("content_hash"),
        F.concat(L("author "), (key % 11).cast("string")).alias("author_name"),
        F.when(F.col("event_type") == "error", "open").when(F.col("event_type") == "click", "in_progress")
        .otherwise("resolved").alias("status"),
        F.col("ts").alias("created_at"),
    )


CTE["tickets"] = f"""
SELECT event_id AS id, user_id AS briefing_id, {_market_sql("event_id")} AS market,
  (event_id % 9)::INT AS segment_index,
  CASE event_id % 3 WHEN 1 THEN sha256('Field ' || (event_id % 9) || chr(1) || trim(coalesce(text, ''), E' \\t\\n\\r') || chr(1))
    WHEN 2 THEN 'stale' END AS content_hash,
  'author ' || (event_id % 11) AS author_name,
  CASE event_type WHEN 'error' THEN 'open' WHEN 'click' THEN 'in_progress' ELSE 'resolved' END AS status,
  ts AS created_at
FROM events e LEFT JOIN segments s ON e.user_id = s.briefing_id AND (e.event_id % 9)::INT = s.segment_index
"""


def glossary_terms(m: Model) -> DataFrame:
    """Stored terms: every distinct word of the benchmark passages, plus part
    names. Unique per (language, source)."""
    words = m.raw("benchmark").select(F.explode(F.split("text", "[^\\p{L}]+")).alias("word"))
    words = words.filter(F.col("word") != "").groupBy("word").agg(F.count(L(1)).alias("n"))
    words = words.select(
        F.expr("conv(substr(sha2(word, 256), 1, 15), 16, 10)").cast("long").alias("id"),
        F.col("word").alias("source"), F.reverse("word").alias("target"),
    )
    parts = m.raw("part").groupBy("p_name").agg(F.min("p_partkey").alias("k"), F.min("p_type").alias("t")).select(
        (F.col("k") + (1 << 40)).alias("id"), F.col("p_name").alias("source"), F.col("t").alias("target")
    )
    return words.unionByName(parts).select(
        "id", _market(F.col("id")).alias("language"), "source", "target"
    )


CTE["glossary_terms"] = f"""
SELECT id, {_market_sql("id")} AS language, source, target FROM (
  SELECT ('0x' || left(sha256(word), 15))::BIGINT AS id, word AS source, reverse(word) AS target
  FROM (SELECT DISTINCT unnest(regexp_split_to_array(text, '[^\\p{{L}}]+')) AS word FROM benchmark)
  WHERE word <> ''
  UNION ALL
  SELECT min(p_partkey) + 1099511627776, p_name, min(p_type) FROM part GROUP BY p_name)
"""


def glossary_grid(m: Model) -> DataFrame:
    """One market grid per brand: a title row, a header row, then the parts."""
    brand = F.regexp_extract("p_brand", "([0-9]+)$", 1).cast("int")
    head = F.array(L("en"), L("Notes"), L("NL"), L("fr"), L("NOR"), L("NL"))
    rows = m.raw("part").select(
        brand.alias("sheet_idx"), F.col("p_brand").alias("sheet"),
        (F.col("p_partkey") + 8).alias("row_idx"),
        F.array(
            F.when(F.col("p_partkey") % 23 == 0, L("")).otherwise(F.col("p_name")),
            F.col("p_partkey").cast("string"),
            L("unused"),
            F.when(F.col("p_size") % 3 == 0, F.col("p_name")).otherwise(F.lower("p_type")),
            F.concat(F.col("p_type"), L(" "), F.col("p_size").cast("string")),
            F.when(F.col("p_size") % 7 == 0, L("")).otherwise(F.concat(L("nl "), F.col("p_type"))),
        ).alias("cells"),
    )
    heads = rows.groupBy("sheet_idx", "sheet").agg(F.count(L(1)).alias("n")).select(
        "sheet_idx", "sheet",
        F.inline(F.array(
            F.struct(L(0).cast("long").alias("row_idx"), F.array(F.col("sheet")).alias("cells")),
            F.struct(L(1).cast("long").alias("row_idx"), head.alias("cells")),
        )),
    )
    # One brand has no header at all and is skipped by the reader.
    return heads.filter("sheet_idx <> 7").unionByName(rows)


CTE["glossary_grid"] = """
SELECT regexp_extract(p_brand, '([0-9]+)$', 1)::INT AS sheet_idx, p_brand AS sheet, p_partkey + 8 AS row_idx,
  [CASE WHEN p_partkey % 23 = 0 THEN '' ELSE p_name END, p_partkey::VARCHAR, 'unused',
   CASE WHEN p_size % 3 = 0 THEN p_name ELSE lower(p_type) END, p_type || ' ' || p_size,
   CASE WHEN p_size % 7 = 0 THEN '' ELSE 'nl ' || p_type END] AS cells
FROM part
UNION ALL SELECT DISTINCT regexp_extract(p_brand, '([0-9]+)$', 1)::INT, p_brand, 0, [p_brand]
  FROM part WHERE p_brand <> 'Brand#7'
UNION ALL SELECT DISTINCT regexp_extract(p_brand, '([0-9]+)$', 1)::INT, p_brand, 1, ['en', 'Notes', 'NL', 'fr', 'NOR', 'NL']
  FROM part WHERE p_brand <> 'Brand#7'
"""


def copy_grid(m: Model) -> DataFrame:
    """Copy sheets: four sheets of request blocks built from the conversations.

    Row numbers leave a wide gap per request, so that they only order rows."""
    conv, turn = F.col("conv_id"), F.col("turn")
    sheet = F.concat(L("Copy "), (conv % 4).cast("string"))
    base = (conv + 1) * (1 << 20)
    text = _with_blanks(m, 7, 3).select(
        sheet.alias("sheet"), (base + 16 + turn).alias("row_idx"),
        F.array(
            F.when(turn % 2 == 0, F.col("role")).otherwise(L("")),
            F.when((turn >= 1000) & (turn % 6 == 4), L("")).otherwise(
                F.concat(L("Line "), turn.cast("string"), L(" (Max"), (turn * 10).cast("string"), L(")"))),
            F.col("text"),
        ).alias("cells"),
    )
    heads = m.briefings.select(
        F.concat(L("Copy "), (F.col("id") % 4).cast("string")).alias("sheet"),
        ((F.col("id") + 1) * (1 << 20)).alias("base"), F.col("id").cast("string").alias("c"),
        (F.col("id") % 3).alias("r"),
    ).select(
        "sheet",
        F.inline(F.array(
            F.struct(F.col("base").alias("row_idx"),
                     F.array(F.concat(L("Request nr. "), F.col("c"))).alias("cells")),
            F.struct((F.col("base") + 1).alias("row_idx"),
                     F.array(L("Email"), L(""), F.when(F.col("r") == 0, L("")).otherwise(
                         F.concat(L("mail "), F.col("c")))).alias("cells")),
            F.struct((F.col("base") + 2).alias("row_idx"),
                     F.array(L("DUE"), F.concat(L("day "), F.col("c"))).alias("cells")),
            F.struct((F.col("base") + 3).alias("row_idx"),
                     F.array(L("due"), L("late"), F.col("c")).alias("cells")),
        )),
    )
    titles = heads.groupBy("sheet").agg(F.count(L(1)).alias("n")).select(
        "sheet", L(2).cast("long").alias("row_idx"),
        F.array(L("Block"), L("Field"), L("EN"), L("NL")).alias("cells"),
    )
    return text.unionByName(heads).unionByName(titles)


CTE["copy_grid"] = f"""
SELECT 'Copy ' || (conv_id % 4) AS sheet, (conv_id + 1) * 1048576 + 16 + turn AS row_idx,
  [CASE WHEN turn % 2 = 0 THEN role ELSE '' END,
   CASE WHEN turn >= 1000 AND turn % 6 = 4 THEN '' ELSE 'Line ' || turn || ' (Max' || (turn * 10) || ')' END,
   text] AS cells FROM {_with_blanks_sql(7, 3)}
UNION ALL SELECT 'Copy ' || (id % 4), (id + 1) * 1048576, ['Request nr. ' || id] FROM briefings
UNION ALL SELECT 'Copy ' || (id % 4), (id + 1) * 1048576 + 1,
  ['Email', '', CASE WHEN id % 3 = 0 THEN '' ELSE 'mail ' || id END] FROM briefings
UNION ALL SELECT 'Copy ' || (id % 4), (id + 1) * 1048576 + 2, ['DUE', 'day ' || id] FROM briefings
UNION ALL SELECT 'Copy ' || (id % 4), (id + 1) * 1048576 + 3, ['due', 'late', id::VARCHAR] FROM briefings
UNION ALL SELECT DISTINCT 'Copy ' || (id % 4), 2, ['Block', 'Field', 'EN', 'NL'] FROM briefings
"""


# --- runs ---------------------------------------------------------------------

def workflow_runs(m: Model) -> DataFrame:
    key = F.col("o_orderkey")
    return m.raw("orders").select(
        key.alias("id"), F.concat(L("wf-"), (F.col("o_custkey") % 50).cast("string")).alias("workflow_id"),
        F.col("o_custkey").alias("user_id"),
        F.when(F.col("o_orderstatus") == "F", "completed").otherwise("running").alias("status"),
        F.when(key % 3 == 0, "SUCCEEDED").when(key % 3 == 1, "FAILED").otherwise("ACTIVE").alias("state"),
        F.col("o_orderdate").alias("started_at"),
        F.when(
            key % 3 != 2,
            F.timestamp_micros(
                F.unix_micros("o_orderdate") + F.round(F.col("o_totalprice") * 100).cast("long") * 10000
            ),
        ).alias("ended_at"),
    )


CTE["workflow_runs"] = """
SELECT o_orderkey AS id, 'wf-' || (o_custkey % 50) AS workflow_id, o_custkey AS user_id,
  CASE WHEN o_orderstatus = 'F' THEN 'completed' ELSE 'running' END AS status,
  CASE o_orderkey % 3 WHEN 0 THEN 'SUCCEEDED' WHEN 1 THEN 'FAILED' ELSE 'ACTIVE' END AS state,
  o_orderdate AS started_at,
  CASE WHEN o_orderkey % 3 <> 2 THEN o_orderdate + to_microseconds(round(o_totalprice * 100)::BIGINT * 10000) END AS ended_at
FROM orders
"""


def step_entries(m: Model) -> DataFrame:
    """Executed steps of a run, in order; a step may run twice. Written once to the
    shared folder: inputs, outputs and lookups all read them, often several times."""
    lines = m.raw("lineitem").groupBy("l_orderkey", "l_linenumber", "l_suppkey").agg(
        F.max("l_partkey").alias("part")
    )
    entries = lines.select(
        F.col("l_orderkey").alias("run_id"),
        (F.col("l_linenumber").cast("long") * (1 << 32) + F.col("l_suppkey")).alias("entry_pos"),
        F.concat(L("step_"), (F.col("l_linenumber") % 4).cast("string")).alias("step_id"),
        F.col("part"),
    )
    return cut_lineage(entries, "entries")


CTE["step_entries"] = """
SELECT l_orderkey AS run_id, l_linenumber::BIGINT * 4294967296 + l_suppkey AS entry_pos,
  'step_' || (l_linenumber % 4) AS step_id, max(l_partkey) AS part
FROM lineitem GROUP BY l_orderkey, l_linenumber, l_suppkey
"""


def step_outputs(m: Model) -> DataFrame:
    p = F.col("part")
    value = (
        F.when(p % 4 == 0, p.cast("string"))
        .when(p % 4 == 1, F.concat(L('{"sourceAssetId":'), p.cast("string"), L("}")))
        .when(p % 4 == 2, F.concat(L("["), p.cast("string"), L(","), (p + 1).cast("string"), L("]")))
        .otherwise(F.concat(L('{"sourceMediaItem":{"mediaItemId":'), p.cast("string"), L("}}")))
    )
    return m.step_entries.select(
        "run_id", "entry_pos", "step_id",
        F.when(p % 5 == 0, "image").otherwise("video").alias("output"), value.alias("value"),
    )


CTE["step_outputs"] = """
SELECT run_id, entry_pos, step_id, CASE WHEN part % 5 = 0 THEN 'image' ELSE 'video' END AS output,
  CASE part % 4 WHEN 0 THEN part::VARCHAR WHEN 1 THEN '{"sourceAssetId":' || part || '}'
    WHEN 2 THEN '[' || part || ',' || (part + 1) || ']'
    ELSE '{"sourceMediaItem":{"mediaItemId":' || part || '}}' END AS value
FROM step_entries
"""


def step_inputs(m: Model) -> DataFrame:
    """Two input items per entry: a reference to another step and a literal."""
    p = F.col("part")
    return m.step_entries.select(
        "run_id", "entry_pos", "step_id", L("source").alias("input"),
        F.inline(F.array(
            F.struct(L(0).alias("item_pos"),
                     F.concat(L("step_"), (p % 4).cast("string")).alias("ref_step"),
                     F.when(p % 2 == 0, "image").otherwise("video").alias("ref_output"),
                     L(None).cast("string").alias("literal")),
            F.struct(L(1).alias("item_pos"), L(None).cast("string").alias("ref_step"),
                     L(None).cast("string").alias("ref_output"), (p + 7).cast("string").alias("literal")),
        )),
    )


CTE["step_inputs"] = """
SELECT run_id, entry_pos, step_id, 'source' AS input, 0 AS item_pos, 'step_' || (part % 4) AS ref_step,
  CASE WHEN part % 2 = 0 THEN 'image' ELSE 'video' END AS ref_output, NULL::VARCHAR AS literal FROM step_entries
UNION ALL
SELECT run_id, entry_pos, step_id, 'source', 1, NULL, NULL, (part + 7)::VARCHAR FROM step_entries
"""


def clips(m: Model) -> DataFrame:
    """Audio clips: one track per user, start within the month, in seconds."""
    start = F.unix_micros("ts") - F.unix_micros(L("2024-01-01").cast("timestamp"))
    return m.raw("events").select(
        F.col("event_id").alias("clip_id"), F.col("user_id").alias("track_index"),
        start.alias("start_us"),
        (start / L(1e6)).alias("start_time"),
        (F.col("value") * 250).alias("duration"),
    )


CTE["clips"] = """
SELECT event_id AS clip_id, user_id AS track_index, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS start_us,
  (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6 AS start_time, value * 250 AS duration
FROM events
"""


# --- research text ---------------------------------------------------------------

def reports(m: Model) -> DataFrame:
    """Markdown per document: its lines become headings, list items or prose."""
    marked = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.when(i % 7 == 0, F.concat(L("## Sub-questions "), i.cast("string")))
        .when(i % 7 == 3, F.concat(L("### Claims to treat with CAUTION "), i.cast("string")))
        .when(i % 7 == 5, F.concat(L("Prose "), line))
        .when(i % 2 == 0, F.concat(L("- "), line))
        .otherwise(F.concat(L("  "), (i + 1).cast("string"), L(") "), line)),
    )
    return m.raw("documents").select(
        F.col("doc_id").alias("id"),
        F.array_join(marked, "\n").alias("research_plan"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(L("# Next Search queries\n* "), F.col("text"), L("\n* gap two")))
        .when(F.col("doc_id") % 3 == 1, L("# Next search\nNone")).alias("gap_analysis"),
    )


CTE["reports"] = """
SELECT doc_id AS id, (
    SELECT string_agg(CASE
      WHEN i % 7 = 0 THEN '## Sub-questions ' || i
      WHEN i % 7 = 3 THEN '### Claims to treat with CAUTION ' || i
      WHEN i % 7 = 5 THEN 'Prose ' || line
      WHEN i % 2 = 0 THEN '- ' || line
      ELSE '  ' || (i + 1) || ') ' || line END, chr(10) ORDER BY i)
    FROM (SELECT unnest(string_split(text, chr(10))) AS line,
      generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i)) AS research_plan,
  CASE doc_id % 3 WHEN 0 THEN '# Next Search queries' || chr(10) || '* ' || text || chr(10) || '* gap two'
    WHEN 1 THEN '# Next search' || chr(10) || 'None' END AS gap_analysis
FROM documents
"""


def media_templates(m: Model) -> DataFrame:
    key = F.col("p_partkey")
    mime = F.when(key % 3 == 0, "image/png").when(key % 3 == 1, "video/mp4").otherwise("audio/wav")
    return m.raw("part").select(
        key.alias("id"), F.col("p_name").alias("name"), mime.alias("mime_type"), F.col("p_type").alias("industry"),
        F.when(key % 7 != 0, F.col("p_brand")).alias("brand"),
        F.when(key % 11 != 0, F.concat(F.split("p_name", " "), F.array(F.concat(L("size-"), F.col("p_size").cast("string"))))).alias("tags"),
        (L("1996-01-01").cast("timestamp") + F.make_dt_interval((key % 1000).cast("int"))).alias("created_at"),
    )


CTE["media_templates"] = """
SELECT p_partkey AS id, p_name AS name, CASE p_partkey % 3 WHEN 0 THEN 'image/png' WHEN 1 THEN 'video/mp4' ELSE 'audio/wav' END AS mime_type,
  p_type AS industry, CASE WHEN p_partkey % 7 <> 0 THEN p_brand END AS brand,
  CASE WHEN p_partkey % 11 <> 0 THEN list_append(string_split(p_name, ' '), 'size-' || p_size) END AS tags,
  TIMESTAMP '1996-01-01' + to_days((p_partkey % 1000)::INT) AS created_at FROM part
"""


TABLES = {
    f.__name__: f
    for f in (
        media_items, media_links, media_items_linked, users, workspaces, workspace_members,
        source_assets, tags, media_item_tags, source_asset_tags, segments, translations,
        briefings, feedback_requests, tickets, glossary_terms, glossary_grid, copy_grid,
        workflow_runs, step_entries, step_outputs, step_inputs, clips, reports, media_templates,
    )
}
