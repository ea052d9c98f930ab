"""Copy sheets, glossaries, translations and their review.

Segments are rows ``(briefing_id, segment_index, ...)``, never one array per
briefing, so a very large briefing is spread like any other data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loometry import fixed
from loometry.functions import text as tx
from loometry.functions.review import content_hash, is_changed, link_status
from loometry.operators.scans import CHUNK_ROWS, chunk_of, first_rows, scan


def _cell(index) -> Column:
    index = F.lit(index) if isinstance(index, int) else index
    return F.coalesce(F.get("cells", index), F.lit(""))


# --- market grids -----------------------------------------------------------------

def market_columns(grid: DataFrame, keys: Sequence[str] = ("sheet",)) -> DataFrame:
    """Header row and market columns of each sheet: the first of the first rows
    with an ``EN`` cell. A market named twice keeps its last column. Sheets
    without a header are left out."""
    codes = F.transform("cells", lambda c: _alias(F.upper(c)))
    named = F.transform(codes, lambda c, i: F.struct(c.alias("market"), i.alias("col")))
    known = F.filter(named, lambda x: x["market"].isin(list(fixed.MARKETS)))
    # array_position from the back gives the last column of a market.
    last = F.map_from_entries(F.transform(
        F.array_distinct(F.transform(known, lambda x: x["market"])),
        lambda m: F.struct(m, F.array_max(F.transform(F.filter(known, lambda x: x["market"] == m), lambda x: x["col"]))),
    ))
    heads = grid.filter(
        (F.col("row_idx") < fixed.HEADER_SEARCH_ROWS)
        & F.array_contains(F.transform("cells", lambda c: F.upper(c)), fixed.SOURCE_MARKET)
    )
    return heads.groupBy(*keys).agg(
        F.min("row_idx").alias("header_row"), F.min_by(last, "row_idx").alias("columns")
    )


def _alias(code: Column) -> Column:
    for other, market in fixed.MARKET_ALIASES.items():
        code = F.when(code == other, market).otherwise(code)
    return code


def glossary_from_grid(grid: DataFrame) -> DataFrame:
    """(market, source, target) from market grids. Inside a sheet the first row
    of a term wins; among sheets the last sheet (``sheet_idx``) wins."""
    heads = market_columns(grid, ["sheet_idx"])
    rows = grid.join(heads, "sheet_idx").filter(F.col("row_idx") > F.col("header_row"))
    source = _cell(F.col("columns")[fixed.SOURCE_MARKET])
    terms = rows.filter(source != "").select(
        "sheet_idx", "row_idx", source.alias("source"), "cells", F.explode("columns").alias("market", "col")
    )
    terms = terms.filter(F.col("market") != fixed.SOURCE_MARKET).withColumn("target", _cell(F.col("col")))
    good = terms.filter((F.col("target") != "") & (F.col("target") != F.col("source")))
    return good.groupBy("market", "source").agg(
        F.max_by("target", F.struct(F.col("sheet_idx"), -F.col("row_idx"))).alias("target")
    )


# --- copy sheets ------------------------------------------------------------------

def sheet_requests(grid: DataFrame, rows: int = CHUNK_ROWS) -> DataFrame:
    """Rows of a copy sheet with their request number and current block.

    A request begins where column A reads ``Request nr``; rows before the first
    one drop out. A non-empty column A that is neither a marker nor a metadata
    label names the block of the rows that follow, within its request."""
    a = F.coalesce(F.get("cells", F.lit(0)), F.lit(""))
    marker = a.rlike(r"(?i)^request\s*nr")
    is_meta = F.lower(a).isin(list(fixed.METADATA_LABELS))
    block = F.when(marker, F.struct(F.lit(None).cast("string").alias("b"))).when(
        (a != "") & ~is_meta, F.struct(a.alias("b"))
    )
    marked = grid.select(
        "sheet", "row_idx", "cells", a.alias("a"), marker.alias("is_marker"), is_meta.alias("is_meta"),
    )
    out = scan(
        marked, ["sheet"], ["row_idx"], chunk_of("row_idx", rows),
        counts={"request_no": F.col("is_marker")}, last={"_block": block},
    )
    return out.filter(F.col("request_no") > 0).select(
        "sheet", "row_idx", "cells", "a", "is_marker", "is_meta",
        (F.col("request_no") - 1).alias("request_index"), F.col("_block.b").alias("block"),
    )


def _with_source_column(rows: DataFrame, grid: DataFrame) -> DataFrame:
    heads = market_columns(grid).select("sheet", F.col("columns")[fixed.SOURCE_MARKET].alias("en_col"))
    return rows.join(heads, "sheet")


def request_metadata(rows: DataFrame, grid: DataFrame) -> DataFrame:
    """One row per request: label, name and the metadata values. A value sits in
    the EN column, else in column B; of two rows with one label the later wins."""
    placed = _with_source_column(rows, grid)
    value = F.when(_cell(F.col("en_col")) != "", _cell(F.col("en_col"))).otherwise(_cell(1))
    fields = [
        F.max_by(value, F.when(F.lower("a") == label, F.col("row_idx"))).alias(key)
        for label, key in fixed.METADATA_LABELS.items()
    ]
    out = placed.groupBy("sheet", "request_index").agg(
        F.max(F.when(F.col("is_marker"), F.col("a"))).alias("request_label"), *fields
    )
    name = F.coalesce(
        F.nullif("email", F.lit("")), F.nullif("request_label", F.lit("")), F.concat("sheet", F.lit(" request"))
    )
    return out.withColumn("name", name)


def request_segments(rows: DataFrame, grid: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Segments of every request, numbered from 0: the rows with a field label
    in column B."""
    label = _cell(1)
    kept = _with_source_column(rows, grid).filter(~F.col("is_marker") & ~F.col("is_meta") & (label != ""))
    shaped = kept.select(
        "sheet", "request_index", "row_idx", "block", tx.field_name(label).alias("field"), label.alias("label"),
        tx.char_limit(label).alias("char_limit"), _cell(F.col("en_col")).alias("text"),
    )
    numbered = scan(
        shaped, ["sheet", "request_index"], ["row_idx"], chunk_of("row_idx", chunk_rows), number="_n"
    )
    return numbered.withColumn("segment_index", F.col("_n") - 1).drop("_n", "row_idx")


def filled_segments(rows: DataFrame, segments: DataFrame) -> DataFrame:
    """Requests of each sheet with their number of non-empty segments."""
    requests = rows.filter("is_marker").select("sheet", "request_index", F.col("a").alias("label"))
    filled = segments.groupBy("sheet", "request_index").agg(F.count_if(F.col("text") != "").alias("filled"))
    return requests.join(filled, ["sheet", "request_index"], "left").withColumn(
        "filled", F.coalesce("filled", F.lit(0))
    )


# --- translations -----------------------------------------------------------------

def aligned(segments: DataFrame, translations: DataFrame) -> DataFrame:
    """Segments beside their translation, per market of the briefing; a missing
    translation is empty."""
    markets = translations.select("briefing_id", "market").distinct()
    spread = segments.join(markets, "briefing_id")
    texts = translations.select("briefing_id", "market", "segment_index", F.col("text").alias("translation"))
    return spread.join(texts, ["briefing_id", "market", "segment_index"], "left").withColumn(
        "translation", F.coalesce("translation", F.lit(""))
    )


def export_grid(segments: DataFrame, translations: DataFrame, markets: Sequence[str] | None = None, rows: int = CHUNK_ROWS) -> DataFrame:
    """Segments as sheet rows: block (only where it changes), label, source text
    and one column per market in fixed order. A market a briefing is not
    translated into is null, a missing translation is empty."""
    markets = [m for m in fixed.TARGET_MARKETS if markets is None or m in markets]
    # One value per (briefing, segment, market): max picks it.
    wide = translations.groupBy("briefing_id", "segment_index").pivot("market", markets).agg(F.max("text"))
    have = translations.groupBy("briefing_id").agg(F.collect_set("market").alias("_have"))
    lined = scan(
        segments, ["briefing_id"], ["segment_index"], chunk_of("segment_index", rows), before={"_prev": F.col("block")},
    )
    lined = lined.join(wide, ["briefing_id", "segment_index"], "left").join(have, "briefing_id", "left")
    first = F.col("segment_index") == 0
    changed = first | ~F.col("block").eqNullSafe(F.col("_prev"))
    return lined.select(
        "briefing_id", "segment_index",
        F.when(changed, F.coalesce("block", F.lit(""))).otherwise("").alias("block"),
        "label", F.col("text").alias(fixed.SOURCE_MARKET),
        *[
            F.when(F.array_contains("_have", m), F.coalesce(F.col(m), F.lit(""))).alias(m)
            for m in markets
        ],
    )


def export_head(meta: DataFrame) -> DataFrame:
    """Rows that stand above the segments of an export: the name, then the
    metadata that is set. ``meta`` (briefing_id, name, email, ...)."""
    lines = F.array(
        F.struct(F.lit(0).alias("line"), F.col("name").alias("label"), F.lit("").alias("value")),
        *[
            F.struct(F.lit(i + 1).alias("line"), F.lit(label).alias("label"), F.coalesce(key, F.lit("")).alias("value"))
            for i, (key, label) in enumerate(fixed.EXPORT_LABELS.items())
        ],
    )
    return meta.select("briefing_id", F.inline(lines)).filter((F.col("line") == 0) | (F.col("value") != ""))


def export_sheet(meta: DataFrame, segments: DataFrame, translations: DataFrame, rows: int = CHUNK_ROWS) -> DataFrame:
    """Every row of every briefing's sheet: (briefing_id, part, line, cells), in order of
    part and line. Part 0 is the header (two empty cells, the source market, then the
    markets translated into, in fixed order), part 1 the name and the metadata that is
    set, part 2 an empty row, part 3 the segments. ``meta`` has the briefings and their
    name and metadata; a briefing without segments has no part 3."""
    markets = list(fixed.TARGET_MARKETS)
    have = translations.groupBy("briefing_id").agg(F.collect_set("market").alias("_have"))
    known = F.coalesce("_have", F.array().cast("array<string>"))
    listed = F.filter(F.array(*[F.lit(m) for m in markets]), lambda m: F.array_contains(known, m))
    header = meta.select("briefing_id").join(have, "briefing_id", "left").select(
        "briefing_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("line"),
        F.concat(F.array(F.lit(""), F.lit(""), F.lit(fixed.SOURCE_MARKET)), listed).alias("cells"),
    )
    # The name is the first cell; a metadata row leaves the second one empty.
    named = F.when(F.col("line") == 0, F.array("label")).otherwise(F.array(F.col("label"), F.lit(""), F.col("value")))
    head = export_head(meta).select("briefing_id", F.lit(1).alias("part"), F.col("line").cast("long").alias("line"), named.alias("cells"))
    spacer = meta.select("briefing_id", F.lit(2).alias("part"), F.lit(0).cast("long").alias("line"), F.array().cast("array<string>").alias("cells"))
    wide = export_grid(segments, translations, None, rows)
    # A market that the briefing is not translated into is null in the grid.
    texts = F.filter(F.array(*[F.col(m) for m in markets]), lambda x: x.isNotNull())
    fixed_cells = F.array(F.col("block"), F.coalesce("label", F.lit("")), F.coalesce(fixed.SOURCE_MARKET, F.lit("")))
    body = wide.select("briefing_id", F.lit(3).alias("part"), F.col("segment_index").cast("long").alias("line"), F.concat(fixed_cells, texts).alias("cells"))
    return header.unionByName(head).unionByName(spacer).unionByName(body)


def write_export(sheet: DataFrame, path: str) -> None:
    """CSV files of whole sheets in order: rows are range-partitioned by briefing and
    place, so a file holds many small briefings, and a large one spans several files.
    The first columns of a row tell its briefing and place."""
    order = ["briefing_id", "part", "line"]
    widest = 3 + len(fixed.TARGET_MARKETS)
    cells = [F.get("cells", F.lit(i)).alias(f"c{i}") for i in range(widest)]
    (
        sheet.repartitionByRange(*order).sortWithinPartitions(*order).select(*order, *cells)
        .write.option("header", True).option("escape", '"').mode("overwrite").csv(path)
    )


def over_limit_texts(aligned_rows: DataFrame) -> DataFrame:
    return aligned_rows.withColumn("over", tx.over_limit(F.col("translation"), F.col("char_limit")))


# --- glossary ---------------------------------------------------------------------

def glossary_summary(terms: DataFrame, n: int = fixed.GLOSSARY_SAMPLES) -> DataFrame:
    """Per market: number of terms and the first samples, beside the total."""
    counts = terms.groupBy(F.col("language").alias("market")).agg(F.count(F.lit(1)).alias("count"))
    samples = glossary_samples(terms, n).groupBy(F.col("language").alias("market")).agg(
        F.array_sort(F.collect_list(F.struct("rank", "source", "target"))).alias("samples")
    )
    total = terms.agg(F.count(F.lit(1))).scalar()
    return counts.join(samples, "market", "left").withColumn("total", total)


def glossary_samples(terms: DataFrame, n: int = fixed.GLOSSARY_SAMPLES) -> DataFrame:
    """The first ``n`` terms of each market, by id."""
    return first_rows(terms, ["language"], [F.col("id")], n, number="rank").select(
        "language", "rank", "source", "target"
    )


def search_glossary(terms: DataFrame, market: str | None = None, text: str | None = None) -> DataFrame:
    """Terms of a market (or all) that hold the text in source or target."""
    out = terms.filter(F.col("language") == market) if market else terms
    if text:
        needle = F.lit(text.lower())
        out = out.filter(F.contains(F.lower("source"), needle) | F.contains(F.lower("target"), needle))
    return out.orderBy(F.lower("source"), "id").limit(fixed.GLOSSARY_LIST_ROWS)


def _anchor(needle: Column) -> Column:
    """The longest part of a term without white space; the term itself when it
    is white space only."""
    parts = F.transform(
        F.filter(F.split(needle, "\\s+"), lambda p: p != ""),
        lambda p: F.struct(F.char_length(p).alias("n"), p.alias("p")),
    )
    return F.coalesce(F.array_max(parts)["p"], needle)


#: Letters of a gram; shorter terms stand under the whole of their text.
GRAM = 3


def _grams(column: str, size: int) -> Column:
    """The distinct runs of ``size`` letters, in one pass over the text."""
    return F.array_distinct(F.regexp_extract_all(column, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def _containing(vocabulary: DataFrame, anchors: DataFrame) -> DataFrame:
    """(word, anchor) for the words that contain an anchor.

    Each anchor stands under the gram that the fewest words have. The grams of the words,
    as many as they have letters, meet those by equality, and what meets is compared.
    """
    sized = anchors.select("anchor", F.least(F.char_length("anchor"), F.lit(GRAM)).alias("size"))
    sizes = sorted(r[0] for r in sized.select("size").distinct().collect())  # of 1 to GRAM
    of_words = of_anchors = None
    for size in sizes:
        w = vocabulary.select("word", F.explode(_grams("word", size)).alias("gram"))
        a = sized.filter(F.col("size") == size).select("anchor", F.explode(_grams("anchor", size)).alias("gram"))
        of_words, of_anchors = (w, a) if of_words is None else (of_words.unionAll(w), of_anchors.unionAll(a))
    if of_words is None:
        return vocabulary.select("word", F.lit("").alias("anchor")).filter(F.lit(False))
    counts = of_words.join(of_anchors.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # A gram that no word has rules its anchor out.
    rarest = of_anchors.join(counts, "gram", "left").groupBy("anchor").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("g"))
    under = rarest.filter("g.n > 0").select("anchor", F.col("g.gram").alias("gram"))
    return of_words.join(under, "gram").filter(F.contains("word", F.col("anchor"))).select("word", "anchor")


def _occurrences(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """(briefing_id, needle) where a text contains the needle.

    Terms meet the vocabulary, not the texts: distinct words and the terms' anchors
    meet through grams. A word then leads to its texts. Only terms that reach beyond
    their anchor (several words) are checked on the text.
    """
    anchored = needles.select("needle", _anchor(F.col("needle")).alias("anchor"))
    rows = texts.select("briefing_id", F.xxhash64("t").alias("h"), "t")
    runs = F.array_distinct(F.regexp_extract_all("t", F.lit("\\s+|\\S+"), F.lit(0)))
    words = rows.select("briefing_id", "h", F.explode(runs).alias("word"))
    vocabulary = words.select("word").distinct()
    known = _containing(vocabulary, anchored.select("anchor").distinct())
    reached = words.join(known, "word").select("briefing_id", "h", "anchor").distinct()
    candidates = reached.join(anchored, "anchor")
    alone = candidates.filter(F.col("needle") == F.col("anchor")).select("briefing_id", "needle")
    longer = candidates.filter(F.col("needle") != F.col("anchor")).select("briefing_id", "h", "needle")
    checked = longer.join(rows, ["briefing_id", "h"]).filter(F.contains("t", F.col("needle")))
    return alone.unionByName(checked.select("briefing_id", "needle")).distinct()


def term_hits(segments: DataFrame, terms: DataFrame, markets: DataFrame, *, rows: int = CHUNK_ROWS) -> DataFrame:
    """Which terms of its markets occur in a briefing, inside words too.

    ``segments`` (briefing_id, segment_index, text), ``terms`` (id, language,
    source, target), ``markets`` (briefing_id, market). Each (briefing, market,
    term) is reported once.

    The match is against the briefing's non-empty texts in order, joined by
    blank, line break, blank. A text is therefore padded with the blank that
    touches it; terms that hold a line break themselves are matched against
    neighbouring texts.
    """
    usable = terms.filter(F.coalesce(F.col("source"), F.lit("")) != "").select(
        F.col("id").alias("term_id"), "language", F.lower("source").alias("needle")
    )
    needles = usable.select("needle").distinct()
    texts = segments.filter(F.coalesce(F.col("text"), F.lit("")) != "").select(
        "briefing_id", "segment_index", F.lower("text").alias("t")
    )
    ends = texts.groupBy("briefing_id").agg(F.min("segment_index").alias("lo"), F.max("segment_index").alias("hi"))
    padded = texts.join(ends, "briefing_id").select(
        "briefing_id",
        F.concat(
            F.when(F.col("segment_index") > F.col("lo"), " ").otherwise(""), F.col("t"),
            F.when(F.col("segment_index") < F.col("hi"), " ").otherwise(""),
        ).alias("t"),
    )
    breaks = F.char_length("needle") - F.char_length(F.replace(F.col("needle"), F.lit("\n"), F.lit("")))
    found = _occurrences(padded, needles.filter(breaks == 0))
    most = needles.agg(F.max(breaks)).first()[0]
    if most:
        wide = _neighbours(texts, most, rows)
        found = found.unionByName(_occurrences(wide, needles.filter(breaks > 0)))
    hits = found.join(usable, "needle").select("briefing_id", F.col("language").alias("market"), "term_id")
    return hits.join(markets.select("briefing_id", "market").distinct(), ["briefing_id", "market"], "left_semi")


def _neighbours(texts: DataFrame, breaks: int, rows: int) -> DataFrame:
    """Each text joined with those after it, as far as a term with ``breaks``
    line breaks can reach (the text before and after only lend separators)."""
    numbered = scan(texts, ["briefing_id"], ["segment_index"], chunk_of("segment_index", rows), number="pos")
    first = F.greatest(F.lit(1), F.col("pos") - (breaks + 1))
    reach = numbered.select("briefing_id", F.explode(F.sequence(first, F.col("pos"))).alias("start"), "pos", "t")
    wide = reach.groupBy("briefing_id", "start").agg(F.array_sort(F.collect_list(F.struct("pos", "t"))).alias("parts"))
    return wide.select("briefing_id", F.array_join(F.transform("parts", lambda p: p["t"]), " \n ").alias("t"))


def relevant_terms(segments: DataFrame, terms: DataFrame, markets: DataFrame, n: int = fixed.GLOSSARY_HITS, **options) -> DataFrame:
    """The first ``n`` matching terms per briefing and market, by term id."""
    hits = term_hits(segments, terms, markets, **options)
    top = first_rows(hits, ["briefing_id", "market"], [F.col("term_id")], n, number="rank")
    return top.join(terms.select(F.col("id").alias("term_id"), "source", "target"), "term_id")


# --- prompts ----------------------------------------------------------------------

def prompt_lines(
    segments: DataFrame, markets: DataFrame, glossary: DataFrame, tone: str | None = None, rows: int = CHUNK_ROWS
) -> DataFrame:
    """The translation request per (briefing, market) as numbered lines.

    ``part`` orders the sections and ``line`` the lines in them. Rows rather
    than one string: nothing bounds the size of a briefing. ``assemble`` joins
    the lines where a single text is wanted.
    """
    filled = segments.filter(tx.strip(F.coalesce("text", F.lit(""))) != "")
    numbered = scan(filled, ["briefing_id"], ["segment_index"], chunk_of("segment_index", rows), number="_n")
    limit = F.when(F.col("char_limit") > 0, F.concat(F.lit(" (max "), F.col("char_limit").cast("string"), F.lit(" chars)"))).otherwise("")
    field = F.when(F.coalesce("block", F.lit("")) != "", F.concat_ws("/", "block", "field")).otherwise(F.col("field"))
    item = F.concat((F.col("_n") - 1).cast("string"), F.lit(". ["), field, limit, F.lit("]: "), F.col("text"))
    active = markets.join(filled.select("briefing_id").distinct(), "briefing_id", "left_semi").select("briefing_id", "market").distinct()
    items = numbered.select("briefing_id", (F.col("_n") - 1).alias("line"), item.alias("text")).join(active, "briefing_id")

    language = tx.language_of(F.col("market"))
    head = [F.format_string(fixed.PROMPT_INTRO, language), F.lit("Rules:"), *[F.lit(r) for r in fixed.PROMPT_RULES]]
    if tone:
        head.append(F.lit(fixed.PROMPT_TONE % tone))
    tail = ["", fixed.PROMPT_FORMAT, "", fixed.PROMPT_ITEMS]

    def section(part: int, lines: list[Column]) -> DataFrame:
        return active.select(
            "briefing_id", "market", F.lit(part).alias("part"), F.posexplode(F.array(*lines)).alias("line", "text")
        )

    # The first term of a pair brings the line that announces the terms.
    term = F.struct(
        F.lit(3).alias("part"), F.col("rank").alias("line"),
        F.concat(F.lit('    "'), F.col("source"), F.lit('" -> "'), F.col("target"), F.lit('"')).alias("text"),
    )
    intro = F.struct(F.lit(2).alias("part"), F.lit(0).alias("line"), F.lit(fixed.PROMPT_GLOSSARY).alias("text"))
    terms = glossary.select(
        "briefing_id", "market", F.inline(F.when(F.col("rank") == 1, F.array(intro, term)).otherwise(F.array(term)))
    )
    columns = ["briefing_id", "market", "part", "line", "text"]
    out = section(1, head)
    for piece in (terms, section(4, [F.lit(t) for t in tail]), items.withColumn("part", F.lit(5))):
        out = out.unionByName(piece.select(*columns))
    return out


def assemble(lines: DataFrame, keys: Sequence[str], order: Sequence[str], separator: str = "\n") -> DataFrame:
    """Lines joined to one text per key, for texts that fit one cell."""
    parts = F.array_sort(F.collect_list(F.struct(*order, "text")))
    return lines.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["text"]), separator).alias("text"))


def apply_replies(segments: DataFrame, replies: DataFrame, rows: int = CHUNK_ROWS) -> DataFrame:
    """Translated text per segment from a reply (briefing_id, market, reply).
    Items are numbered over the non-blank segments; an item the reply lacks
    keeps its source text; blank segments stay empty."""
    blank = tx.strip(F.coalesce("text", F.lit(""))) == ""
    numbered = scan(
        segments, ["briefing_id"], ["segment_index"], chunk_of("segment_index", rows), counts={"_n": ~blank},
    )
    values = replies.select("briefing_id", "market", tx.reply_object(F.col("reply")).alias("_reply"))
    value = tx.strip(F.try_element_at("_reply", (F.col("_n") - 1).cast("string")))
    return numbered.join(values, "briefing_id").select(
        "briefing_id", "market", "segment_index",
        F.when(blank, "").otherwise(F.coalesce(value, F.col("text"))).alias("text"),
    )


# --- review -----------------------------------------------------------------------

def current_hashes(segments: DataFrame, translations: DataFrame, pairs: DataFrame) -> DataFrame:
    """Fingerprint of each asked (briefing_id, market, segment_index)."""
    asked = pairs.select("briefing_id", "market", "segment_index").distinct()
    texts = translations.select("briefing_id", "market", "segment_index", F.col("text").alias("_tr"))
    return asked.join(segments.select("briefing_id", "segment_index", "field", "text"), ["briefing_id", "segment_index"]).join(
        texts, ["briefing_id", "market", "segment_index"], "left"
    ).select(
        "briefing_id", "market", "segment_index", content_hash(F.col("field"), F.col("text"), F.col("_tr")).alias("current_hash")
    )


def flag_changed(tickets: DataFrame, segments: DataFrame, translations: DataFrame) -> DataFrame:
    """``item_changed``: the segment or its translation is not what it was when
    the ticket was written."""
    keys = ["briefing_id", "market", "segment_index"]
    current = current_hashes(segments, translations, tickets)
    return tickets.join(current, keys, "left").withColumn(
        "item_changed", is_changed(F.col("content_hash"), F.col("current_hash"))
    ).select(*tickets.columns, "item_changed")


def ticket_counts(tickets: DataFrame) -> DataFrame:
    return tickets.groupBy("briefing_id", "market").agg(*[
        F.count_if(F.col("status") == s).alias(s) for s in ("open", "in_progress", "resolved")
    ])


def review_overview(requests: DataFrame, tickets: DataFrame, now: Column) -> DataFrame:
    """One row per briefing and market that has a request or a ticket."""
    status = link_status(F.col("token_hash"), F.col("revoked_at"), F.col("expires_at"), now)
    asked = requests.select("briefing_id", "market", "review_state", status.alias("link_status"), "expires_at")
    both = asked.join(ticket_counts(tickets), ["briefing_id", "market"], "full_outer")
    return both.select(
        "briefing_id", "market", F.coalesce("review_state", F.lit("draft")).alias("review_state"),
        F.coalesce("link_status", F.lit("none")).alias("link_status"), "expires_at",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("open", "in_progress", "resolved")],
    )


def market_keys(requests: DataFrame, tickets: DataFrame) -> DataFrame:
    keys = ["briefing_id", "market"]
    return requests.select(*keys).union(tickets.select(*keys)).distinct()


def segment_tickets(tickets: DataFrame) -> DataFrame:
    """Unresolved and resolved tickets per segment."""
    resolved = F.col("status") == "resolved"
    return tickets.groupBy("briefing_id", "market", "segment_index").agg(
        F.count_if(~resolved).alias("unresolved"), F.count_if(resolved).alias("resolved")
    )


def market_progress(states: DataFrame) -> DataFrame:
    """Selected, translated and approved markets per briefing.
    ``states`` (briefing_id, market, status, approval)."""
    return states.groupBy("briefing_id").agg(
        F.count(F.lit(1)).alias("selected"), F.count_if(F.col("status") == "done").alias("done"),
        F.count_if(F.col("approval") == "approved").alias("approved"),
    )


PUBLIC_ITEM = ["briefing_id", "market", "segment_index", "block", "field", "label", "char_limit", "source", "translation"]
PUBLIC_TICKET = ["briefing_id", "market", "id", "segment_index", "author_name", "status", "created_at", "item_changed"]


def public_items(segments: DataFrame, translations: DataFrame, markets: DataFrame) -> DataFrame:
    """What a translator without an account sees of the asked markets: segments
    and translations, no metadata and no other market."""
    asked = markets.select("briefing_id", "market").distinct()
    texts = translations.select("briefing_id", "market", "segment_index", F.col("text").alias("translation"))
    out = segments.withColumnRenamed("text", "source").join(asked, "briefing_id").join(
        texts, ["briefing_id", "market", "segment_index"], "left"
    )
    return out.withColumn("translation", F.coalesce("translation", F.lit(""))).select(*PUBLIC_ITEM)


def public_tickets(tickets: DataFrame, segments: DataFrame, translations: DataFrame) -> DataFrame:
    shown = flag_changed(tickets, segments, translations)
    return shown.select(*[c for c in PUBLIC_TICKET if c in shown.columns])


def check_tickets(drafts: DataFrame, segments: DataFrame, translations: DataFrame) -> DataFrame:
    """New tickets with ``error`` (null when accepted) and, for accepted ones,
    the snapshot and fingerprint of their segment.

    ``drafts`` (id, briefing_id, market, segment_index, author_name, body)."""
    seg = segments.select(
        "briefing_id", "segment_index", "field", F.coalesce(F.nullif("label", F.lit("")), F.col("field")).alias("_label"),
        F.col("text").alias("_source"),
    )
    texts = translations.select("briefing_id", "market", "segment_index", F.col("text").alias("_tr"))
    joined = drafts.join(seg, ["briefing_id", "segment_index"], "left").join(
        texts, ["briefing_id", "market", "segment_index"], "left"
    )
    name, body = tx.strip(F.coalesce("author_name", F.lit(""))), tx.strip(F.coalesce("body", F.lit("")))
    error = F.when(F.col("_source").isNull(), "segment_index is out of range for this briefing.").when(
        (name == "") | (body == ""), "Both a name and a non-empty comment are required."
    )
    ok = error.isNull()
    return joined.select(
        "id", "briefing_id", "market", "segment_index", name.alias("author_name"), body.alias("body"),
        error.alias("error"),
        F.when(ok, F.col("_label")).alias("field_snapshot"), F.when(ok, F.col("_source")).alias("source_snapshot"),
        F.when(ok, content_hash(F.col("field"), F.col("_source"), F.col("_tr"))).alias("content_hash"),
        F.when(ok, "open").alias("status"),
    )
