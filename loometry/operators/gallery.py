"""One table of generated and uploaded media, with search, paging and rights."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loometry import fixed
from loometry.functions.media import (
    extension_from_mime, extension_from_uri, mime_matches, moment_range, not_deleted,
)
from loometry.functions.text import any_contains_ci, contains_ci
from loometry.operators.paging import Page, page, page_rows
from loometry.session import cut_lineage

METADATA_FIELDS = [
    "model", "prompt", "original_prompt", "negative_prompt", "aspect_ratio", "mime_type", "style",
    "lighting", "num_media", "generation_time", "original_filename", "asset_type",
]


def newest_first() -> list[Column]:
    # The item type only settles ties between the two kinds of id.
    return [F.col("created_at").desc_nulls_first(), F.col("id").desc(), F.col("item_type")]


def unified_base(media_items: DataFrame, source_assets: DataFrame) -> DataFrame:
    """Both kinds of media with aligned columns (UNION ALL)."""

    def with_flags(df: DataFrame) -> DataFrame:
        mime = F.col("mime_type")
        return df.withColumn("is_video", mime.startswith("video")).withColumn("is_audio", mime.startswith("audio"))

    head = ["id", "workspace_id", "user_id", "created_at", "item_type", "status", "gcs_uris", "thumbnail_uris", "deleted_at"]
    items = media_items.withColumn("item_type", F.lit("media_item"))
    none = F.array().cast("array<string>")
    assets = source_assets.select(
        "*",
        F.lit("source_asset").alias("item_type"),
        F.lit("completed").alias("status"),
        F.array("gcs_uri").alias("gcs_uris"),
        F.when(F.col("thumbnail_gcs_uri").isNotNull(), F.array("thumbnail_gcs_uri")).otherwise(none).alias("thumbnail_uris"),
    )
    item_fields = [c for c in METADATA_FIELDS if c in media_items.columns]
    asset_fields = [c for c in ("mime_type", "aspect_ratio", "original_filename", "asset_type")]
    left = with_flags(items.select(*head, *item_fields))
    right = with_flags(assets.select(*head, *asset_fields))
    return left.unionByName(right, allowMissingColumns=True)


def item_tags(media_item_tags: DataFrame, source_asset_tags: DataFrame) -> DataFrame:
    """Tag links of both kinds of media as (item_type, item_id, tag_id)."""
    return media_item_tags.select(
        F.lit("media_item").alias("item_type"), F.col("media_item_id").alias("item_id"), "tag_id"
    ).unionByName(
        source_asset_tags.select(
            F.lit("source_asset").alias("item_type"), F.col("source_asset_id").alias("item_id"), "tag_id"
        )
    )


def tag_lists(links: DataFrame, tags: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tags per item as an array, by tag id. An item holds each tag once, so
    its array is no longer than the tag table of its workspace."""
    entry = F.struct("id", "name", "color", "workspace_id")
    return (
        links.join(tags, F.col("tag_id") == F.col("id"))
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_set(entry)).alias("tags"))
    )


def enrich(base: DataFrame, links: DataFrame, tags: DataFrame, workspaces: DataFrame, users: DataFrame) -> DataFrame:
    """Add tags, workspace name and user. Deleted users keep their e-mail here."""
    lists = tag_lists(links, tags, ["item_type", "item_id"]).withColumnRenamed("item_type", "_type")
    names = workspaces.select(F.col("id").alias("_wid"), F.col("name").alias("workspace_name"))
    people = users.select(F.col("id").alias("_uid"), F.col("picture").alias("user_picture"), F.col("email").alias("user_email"))
    return (
        base.drop("user_email")
        .join(lists, (F.col("id") == F.col("item_id")) & (F.col("item_type") == F.col("_type")), "left")
        .join(names, F.col("workspace_id") == F.col("_wid"), "left")
        .join(people, F.col("user_id") == F.col("_uid"), "left")
        .drop("item_id", "_type", "_wid", "_uid")
    )


def metadata_json(df: DataFrame) -> DataFrame:
    """The item's fields as one JSON document, for consumers of that form."""
    fields = [c for c in [*METADATA_FIELDS, "is_video", "is_audio", "tags"] if c in df.columns]
    return df.withColumn("metadata", F.to_json(F.struct(*fields))).drop(*fields)


@dataclass
class Search:
    """Gallery filters; unset ones do not apply."""

    workspace_id: int | None = None
    status: str | None = None
    user_id: int | None = None
    user_email: str | None = None
    mime_type: str | None = None
    model: str | None = None
    item_type: str | None = None
    start: object = None
    end: object = None
    tags: list[str] = field(default_factory=list)
    query: str | None = None
    include_deleted: bool = False
    limit: int = 12
    offset: int = 0

    def for_role(self, is_admin: bool) -> Search:
        """What a caller may see: others than admins get completed items of one
        workspace only."""
        if is_admin:
            return self
        if not self.workspace_id:
            raise ValueError("workspace_id is required for non-admin users.")
        return Search(**{**self.__dict__, "status": "completed"})


def filter_gallery(
    base: DataFrame, search: Search, links: DataFrame | None = None, tags: DataFrame | None = None,
    users: DataFrame | None = None,
) -> DataFrame:
    """Rows of the unified table that match, before any enrichment."""
    cond = not_deleted(search.include_deleted)
    for name in ("workspace_id", "status", "user_id", "model", "item_type"):
        value = getattr(search, name)
        if value is not None:
            cond = cond & (F.col(name) == value)
    if search.mime_type:
        cond = cond & mime_matches(F.col("mime_type"), search.mime_type)
    cond = cond & moment_range(F.col("created_at"), search.start, search.end)
    if search.query:
        cond = cond & any_contains_ci([F.col(c) for c in ("prompt", "model", "original_filename")], search.query)
    out = base.filter(cond)
    if search.user_email:
        owner = users.filter(F.col("email") == search.user_email).select(F.col("id").alias("_uid"))
        out = out.join(owner, F.col("user_id") == F.col("_uid"), "left_semi")
    if search.tags:
        out = with_all_tags(out, links, tags, search.tags, ["item_type"])
    return out


def with_all_tags(
    items: DataFrame, links: DataFrame, tags: DataFrame, names: Sequence[str], extra: Sequence[str] = ()
) -> DataFrame:
    """Items that carry every tag in ``names`` (one pass over the links)."""
    wanted = sorted(set(names))
    hits = (
        links.join(tags.filter(F.col("name").isin(wanted)).select(F.col("id").alias("_tid"), "name"),
                   F.col("tag_id") == F.col("_tid"))
        .groupBy("item_id", *extra)
        .agg(F.count_distinct("name").alias("n"))
        .filter(F.col("n") == len(wanted))
    )
    hits = hits.select(F.col("item_id").alias("_iid"), *[F.col(c).alias(f"_{c}") for c in extra])
    cond = F.col("id") == F.col("_iid")
    for c in extra:
        cond = cond & (F.col(c) == F.col(f"_{c}"))
    return items.join(hits, cond, "left_semi")


def search_rows(
    base: DataFrame, search: Search, links: DataFrame, tags: DataFrame, workspaces: DataFrame, users: DataFrame
) -> DataFrame:
    """One page, enriched. Filters and the top-k run on the bare rows; only the
    rows of the page meet the tag, workspace and user tables."""
    found = filter_gallery(base, search, links, tags, users)
    # At most MAX_PAGE_SIZE rows, used twice below: written once, so the search
    # itself runs once.
    rows = cut_lineage(page_rows(found, newest_first(), search.limit, search.offset), "page")
    keys = F.broadcast(rows.select(F.col("id").alias("_pid"), F.col("item_type").alias("_ptype")))
    mine = links.join(
        keys, (F.col("item_id") == F.col("_pid")) & (F.col("item_type") == F.col("_ptype")), "left_semi"
    )
    return enrich(rows, mine, tags, workspaces, users)


def search_page(
    base: DataFrame, search: Search, links: DataFrame, tags: DataFrame, workspaces: DataFrame, users: DataFrame
) -> Page:
    result = page(filter_gallery(base, search, links, tags, users), newest_first(), search.limit, search.offset)
    result.data = search_rows(base, search, links, tags, workspaces, users)
    return result


def search_assets(
    source_assets: DataFrame, *, mime_type: str | None = None, user_id: int | None = None,
    scope: str | None = None, asset_type: str | None = None, filename_prefix: str | None = None,
    workspace_id: int | None = None, names: Sequence[str] = (), links: DataFrame | None = None,
    tags: DataFrame | None = None,
) -> DataFrame:
    """Uploaded assets by any mix of filters."""
    cond = not_deleted()
    if mime_type:
        cond = cond & mime_matches(F.col("mime_type"), mime_type)
    for name, value in {"user_id": user_id, "scope": scope, "asset_type": asset_type, "workspace_id": workspace_id}.items():
        if value:
            cond = cond & (F.col(name) == value)
    if filename_prefix:
        cond = cond & F.col("original_filename").like(f"{filename_prefix}%")
    out = source_assets.filter(cond)
    if names:
        links = links.withColumnRenamed("source_asset_id", "item_id")
        out = with_all_tags(out, links, tags, names)
    return out


def search_tags(tags: DataFrame, workspace_id: int, text: str | None = None, user_id: int | None = None) -> DataFrame:
    cond = F.col("workspace_id") == workspace_id
    if text:
        cond = cond & contains_ci(F.col("name"), text)
    if user_id:
        cond = cond & (F.col("user_id") == user_id)
    return tags.filter(cond)


def search_users(users: DataFrame, email: str | None = None, role: str | None = None, include_deleted: bool = False) -> DataFrame:
    cond = not_deleted(include_deleted)
    if email:
        cond = cond & contains_ci(F.col("email"), email)
    if role:
        cond = cond & F.array_contains("roles", role)
    return users.filter(cond)


def search_templates(
    templates: DataFrame, *, industry: str | None = None, brand: str | None = None,
    mime_type: str | None = None, tag: str | None = None,
) -> DataFrame:
    cond = F.lit(True)
    for name, value in {"industry": industry, "brand": brand, "mime_type": mime_type}.items():
        if value:
            cond = cond & (F.col(name) == value)
    if tag:
        cond = cond & F.array_contains("tags", tag)
    return templates.filter(cond)


def by_keys(df: DataFrame, column: str, keys: DataFrame | Sequence) -> DataFrame:
    """Rows whose key is listed; an empty list gives no rows."""
    if isinstance(keys, DataFrame):
        return df.join(keys.select(F.col(keys.columns[0]).alias(column)), column, "left_semi")
    return df.filter(F.col(column).isin(list(keys)) if keys else F.lit(False))


def visible_assets(source_assets: DataFrame, user_id: int, types: Sequence[str]) -> DataFrame:
    """System assets and the user's private ones, of the given types."""
    if not types:
        return source_assets.filter(F.lit(False))
    own = (F.col("user_id") == user_id) & (F.col("scope") == "private")
    return source_assets.filter(not_deleted() & ((F.col("scope") == "system") | own) & F.col("asset_type").isin(list(types)))


def try_on_assets(source_assets: DataFrame, user_id: int) -> DataFrame:
    """Assets of the try-on picker, one row each, with the bucket they belong to."""
    names = F.create_map(*[F.lit(x) for pair in fixed.TRY_ON_BUCKETS.items() for x in pair])
    found = visible_assets(source_assets, user_id, list(fixed.TRY_ON_BUCKETS))
    return found.withColumn("bucket", names[F.col("asset_type")])


def may_act(requests: DataFrame, items: DataFrame, workspace_id: int, user_id: int, is_admin: bool) -> DataFrame:
    """Requested (type, id) pairs that exist in the workspace and belong to the
    user (or to anyone, for an admin)."""
    cond = not_deleted() & (F.col("workspace_id") == workspace_id)
    if not is_admin:
        cond = cond & (F.col("user_id") == user_id)
    allowed = items.filter(cond).select(F.col("item_type").alias("_t"), F.col("id").alias("_i"))
    return requests.join(allowed, (F.col("type") == F.col("_t")) & (F.col("id") == F.col("_i")), "left_semi")


def requested(requests: DataFrame, items: DataFrame) -> DataFrame:
    """Every requested (type, id) once, with what is stored of it: ``item`` is null where
    there is no such item, or where it is deleted."""
    stored = items.filter(not_deleted()).select(
        F.col("item_type").alias("_t"), F.col("id").alias("_i"), F.struct(*items.columns).alias("item")
    )
    wanted = requests.select("type", "id").distinct()
    return wanted.join(stored, (F.col("type") == F.col("_t")) & (F.col("id") == F.col("_i")), "left").drop("_t", "_i")


def bulk_outcome(requests: DataFrame, items: DataFrame, workspace_id: int, user_id: int, is_admin: bool) -> DataFrame:
    """What a bulk action does with each requested item: ``done``, or why it is skipped
    (``missing``, ``elsewhere``, ``not_owner``), as (type, id, outcome)."""
    own = F.lit(True) if is_admin else F.coalesce(F.col("item.user_id") == user_id, F.lit(False))
    outcome = (
        F.when(F.col("item").isNull(), "missing")
        .when(~F.coalesce(F.col("item.workspace_id") == workspace_id, F.lit(False)), "elsewhere")
        .when(~own, "not_owner").otherwise("done")
    )
    return requested(requests, items).select("type", "id", outcome.alias("outcome"))


def bulk_counts(outcomes: DataFrame) -> DataFrame:
    """How many requested items were acted on, and how many were skipped and why."""
    count = lambda *names: F.count_if(F.col("outcome").isin(*names))
    return outcomes.agg(
        count("done").alias("done"), count("missing", "elsewhere", "not_owner").alias("skipped"),
        count("missing").alias("missing"), count("elsewhere").alias("elsewhere"), count("not_owner").alias("not_owner"),
    )


def chosen_downloads(
    requests: DataFrame, items: DataFrame, workspaces: DataFrame, members: DataFrame, user_id: int, is_admin: bool
) -> DataFrame:
    """The download manifest of the requested items that exist and lie in a workspace
    that the user may see: public, own, or one they are a member of (any, for an admin)."""
    found = requested(requests, items).filter("item IS NOT NULL").select("item.*")
    if not is_admin:
        seen = visible_workspaces(workspaces, members, user_id).select("id")
        owned = workspaces.filter(F.col("owner_id") == user_id).select("id")
        allowed = seen.unionByName(owned).distinct().select(F.col("id").alias("workspace_id"))
        found = found.join(allowed, "workspace_id", "left_semi")
    return download_manifest(found)


def template_page(templates: DataFrame, limit: int, offset: int = 0, **wanted: str | None) -> Page:
    """A page of the templates found, the newest first."""
    return page(search_templates(templates, **wanted), [F.desc("created_at"), F.desc("id")], limit, offset)


def tags_of(links: DataFrame, tags: DataFrame, item_column: str) -> DataFrame:
    """(item, tag) rows with the tag's fields."""
    return links.join(tags, F.col("tag_id") == F.col("id")).select(
        item_column, "tag_id", "name", "color", "workspace_id"
    )


def workspaces_of_members(workspaces: DataFrame, members: DataFrame) -> DataFrame:
    return members.select("user_id", F.col("workspace_id").alias("_w")).join(
        workspaces, F.col("_w") == F.col("id")
    ).drop("_w")


def membership_flags(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """``is_member`` for each (workspace_id, user_id) pair."""
    known = members.select("workspace_id", "user_id").distinct().withColumn("_m", F.lit(True))
    return pairs.join(known, ["workspace_id", "user_id"], "left").select(
        *pairs.columns, F.coalesce("_m", F.lit(False)).alias("is_member")
    )


def visible_workspaces(workspaces: DataFrame, members: DataFrame, user_id: int) -> DataFrame:
    """Workspaces the user is a member of, and all public ones, each once."""
    mine = workspaces.join(
        members.filter(F.col("user_id") == user_id).select(F.col("workspace_id").alias("id")), "id", "left_semi"
    )
    public = workspaces.filter(F.col("scope") == "public")
    return mine.unionByName(public.select(*mine.columns)).dropDuplicates(["id"])


def download_manifest(items: DataFrame) -> DataFrame:
    """Output name for the first file of each chosen item."""
    uri = F.get("gcs_uris", F.lit(0))
    is_media = F.col("item_type") == "media_item"
    by_mime = F.when(F.coalesce("mime_type", F.lit("")) != "", extension_from_mime(F.col("mime_type")))
    ext = F.when(is_media, F.coalesce(by_mime, extension_from_uri(uri))).otherwise(extension_from_uri(uri))
    prefix = F.when(is_media, "media_").otherwise("asset_")
    return items.filter(not_deleted() & (F.coalesce(uri, F.lit("")) != "")).select(
        "item_type", "id", uri.alias("gcs_uri"),
        F.concat(prefix, F.col("id").cast("string"), F.lit("."), ext).alias("filename"),
    )
