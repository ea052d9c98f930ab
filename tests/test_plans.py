"""Physical plans: filters reach the scan, columns are pruned, no pair joins,
no Python in the data path."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from loometry.plans import catalog
from loometry.operators import reports
from loometry.operators.localization import search_glossary

# User statements are planned as the user wrote them.
USER_SQL = {"q3_theta_lateral"}


def plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - USER_SQL))
def test_no_pair_joins_and_no_python(name, spark, data_dir):
    text = plan(catalog.QUERIES[name](spark, data_dir))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "FlatMapGroups", "MapInPandas"):
        assert bad not in text, f"{bad} in {name}"


def test_date_filter_reaches_the_scan(model):
    text = plan(reports.media_per_workspace(model.media_items, model.workspaces, "1996-01-01", "1996-12-31"))
    pushed = [p for p in re.findall(r"PushedFilters: \[(.*?)\]", text) if "o_orderdate" in p]
    assert pushed and "GreaterThanOrEqual(o_orderdate" in pushed[0] and "LessThan(o_orderdate" in pushed[0]


def test_only_needed_columns_are_read(model):
    text = plan(reports.generation_health(model.media_items))
    schemas = re.findall(r"ReadSchema: struct<(.*?)>", text)
    assert all("o_totalprice" not in s and "o_orderpriority" not in s for s in schemas)
    # Counting jobs needs no line items: the left join to them is not read for its columns.
    assert not any("l_partkey" in s for s in schemas)


def test_workspace_names_join_after_aggregation(model):
    text = plan(reports.media_per_workspace(model.media_items, model.workspaces))
    # The tree prints from the top: the name join stands above both aggregates.
    tree = text[: text.index("(1) Scan")]
    assert tree.index("Inner") < tree.index("HashAggregate")


def test_top_k_instead_of_sort(model):
    assert "TakeOrderedAndProject" in plan(search_glossary(model.glossary_terms, text="er"))


def test_group_limit_before_the_shuffle(model):
    from loometry.operators.localization import glossary_samples

    assert "WindowGroupLimit" in plan(glossary_samples(model.glossary_terms).select(F.col("language")))
