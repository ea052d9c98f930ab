"""String expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from loometry import fixed


def strip(col: Column) -> Column:
    """Trim every whitespace character, not only blanks."""
    return F.btrim(col, F.lit(fixed.WHITESPACE))


def slug(col: Column) -> Column:
    """A column or table name from free text: lower case, words joined by ``_``."""
    words = F.btrim(F.regexp_replace(F.lower(strip(col)), "[^0-9a-zA-Z]+", "_"), F.lit("_"))
    named = F.regexp_replace(F.regexp_replace(words, "^$", "col"), "^(?=[0-9])", "c_")
    return F.substring(named, 1, fixed.MAX_COLUMN_NAME)


def contains_ci(col: Column, text: str) -> Column:
    """Case-insensitive contains. ``%`` and ``_`` in ``text`` stay wildcards."""
    return col.ilike(f"%{text}%")


def any_contains_ci(cols: list[Column], text: str) -> Column:
    """``contains_ci`` over several fields, null counting as empty."""
    found = F.lit(False)
    for col in cols:
        found = found | contains_ci(F.coalesce(col, F.lit("")), text)
    return found


def is_missing_cell(col: Column) -> Column:
    return col.isin(fixed.NA_WORDS)


def parse_number(col: Column) -> Column:
    """The cell as a double, null when a sheet reader would not see a number."""
    body = F.btrim(col, F.lit(" \t\n\r\x0b\x0c"))
    plain = body.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    words = body.rlike(r"(?i)^[+-]?inf(inity)?$")
    value = body.try_cast("double")
    finite = value.isNotNull() & ~F.abs(value).isin(float("inf"))
    unsigned = F.regexp_replace(body, "^[+-]", "")
    infinite = F.when(body.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(plain & finite, value).when(words & (unsigned != ""), infinite)


def parse_whole(col: Column) -> Column:
    """The cell as a long, null when it is not written as a whole number that fits."""
    body = F.btrim(col, F.lit(" \t\n\r\x0b\x0c"))
    return F.when(body.rlike("^[+-]?[0-9]+$"), body.try_cast("long"))


def char_limit(label: Column) -> Column:
    """The number in a ``MAX n`` hint, null when there is none."""
    digits = F.regexp_extract(label, r"(?i)max\s*([0-9]+)", 1)
    return F.nullif(digits, F.lit("")).cast("int")


def field_name(label: Column) -> Column:
    """The label without its closing ``(...)`` hint."""
    return strip(F.regexp_replace(label, r"\s*\(.*?\)\s*$", ""))


def over_limit(text: Column, limit: Column) -> Column:
    """True when a non-zero limit is set and the text is longer."""
    return F.coalesce((limit > 0) & (F.char_length(text) > limit), F.lit(False))


def progress_text(kind: Column, text: Column) -> Column:
    """Progress messages are cut short; tool messages are kept whole."""
    return F.when(kind == "tool", text).otherwise(F.substring(text, 1, fixed.PROGRESS_CHARS))


def display_value(raw: Column) -> Column:
    """A form answer (list of strings) as text for a brief."""
    kept = F.filter(F.transform(raw, strip), lambda item: item != "")
    return F.coalesce(F.nullif(F.array_join(kept, ", "), F.lit("")), F.lit(fixed.NOT_SPECIFIED))


def language_of(market: Column) -> Column:
    """The language a market code stands for; unknown codes stand for themselves."""
    names = F.create_map(*[F.lit(x) for pair in fixed.MARKETS.items() for x in pair])
    return F.coalesce(names[market], market)


def snake_case(name: str) -> str:
    """One header name in lower case, its words joined by ``_``."""
    return re.sub(r"\s+", "_", name.strip()).lower()


def reply_object(reply: Column) -> Column:
    """The JSON object inside a (possibly fenced) reply as map<string,string>."""
    body = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    return F.from_json(F.nullif(body, F.lit("")), "map<string,string>")
