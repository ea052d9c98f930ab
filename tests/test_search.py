"""Contains search by postings against the plain search."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loometry.functions.text import any_contains_ci
from loometry.sources.search import TextIndex, pattern_grams

WORDS = ["Sunset", "harbour", "ΑΣΑ", "ΑΣ", "İstanbul", "100% cotton", "a_b", "back\\slash", "🙂🙃🙂", "two\nlines", "", "x"]
FIELDS = ["title", "note.text"]


@pytest.fixture(scope="module")
def rows(spark):
    made = [(i, f"{WORDS[i % 12]} item {i}", None if i % 5 == 0 else f"{WORDS[i % 7]}-{i * 37 % 1000}") for i in range(600)]
    return spark.createDataFrame([*made, (600, None, None)], "id long, title string, `note.text` string").cache()


@pytest.fixture(scope="module")
def index(rows, tmp_path_factory):
    return TextIndex.create(rows, str(tmp_path_factory.mktemp("index")), ["id"], FIELDS, parts=40)


@pytest.mark.parametrize("pattern", [
    "sunset", "HARBOUR item 1", "item 59_", "un%et", "ab", "", "%", "___", "ασα", "ΑΣ", "istanbul", "100\\% co", "a\\_b item", "🙂🙃🙂 item",
    "two\nlines", "back\\\\slash", "not there", "item 123", "-999", "item", "-37",
])
def test_equals_the_plain_search(rows, index, pattern):
    want = rows.filter(any_contains_ci([F.col(f"`{f}`") for f in FIELDS], pattern))
    found = index.search(pattern)
    assert found.columns == rows.columns
    assert sorted(tuple(map(str, r)) for r in found.collect()) == sorted(tuple(map(str, r)) for r in want.collect())


def test_reads_the_parts_that_can_match(index):
    parts = index.parts_with("item 123")
    assert 0 < len(parts) < 12
    some, every = index.rows(parts), index.rows()
    count = lambda df: df.select(F.input_file_name()).distinct().count()
    assert count(some) == len(parts) and count(every) == 40 and some.count() < every.count() / 3
    # Files of other parts are left out by their folder, before any is opened.
    plan = some._sc._jvm.PythonSQLUtils.explainString(some._jdf.queryExecution(), "formatted")
    assert "_part" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert index.parts_with("not there") == [] and index.rows([]).count() == 0
    assert index.parts_with("a%b_c") is None


def test_grams_of_patterns(spark):
    assert pattern_grams(spark, "ABCD") == ["abc", "bcd"]
    assert pattern_grams(spark, "ab%cd_efg") == ["efg"]
    assert pattern_grams(spark, "a\\%b") == ["a%b"]
    assert pattern_grams(spark, "abc\\") == ["abc", "bc%"]  # takes the closing wildcard as a letter


def test_empty_table_and_bounds(spark, rows, tmp_path):
    empty = TextIndex.create(rows.limit(0), str(tmp_path / "e"), ["id"], FIELDS)
    assert empty.search("sunset").count() == 0 and empty.search("a").count() == 0
    with pytest.raises(ValueError, match="parts"):
        TextIndex.create(rows, str(tmp_path / "f"), ["id"], FIELDS, parts=1 << 20)
