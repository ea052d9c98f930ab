"""Registration of queries with their SQL twins."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loometry.plans.bindings import CTE, Model

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _used(sql: str) -> list[str]:
    return [name for name in CTE if re.search(rf"\b{name}\b", sql)]


def with_bindings(sql: str) -> str:
    """Put the model tables that ``sql`` names in front of it."""
    needed, todo = [], _used(sql)
    while todo:
        name = todo.pop()
        if name not in needed:
            needed.append(name)
            todo += [n for n in _used(CTE[name]) if n != name]
    ordered = [n for n in CTE if n in needed]
    ctes = [f"{n} AS ({CTE[n].strip()})" for n in ordered]
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(ctes + [body[5:]]) if ctes else body
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body


def query(name: str, sql: str | None = None):
    """Register ``build(model) -> DataFrame`` under ``name``."""

    def register(build):
        QUERIES[name] = lambda spark, sf_dir: build(Model(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = sql if sql in ORACLE.values() else with_bindings(sql)
        return build

    return register
