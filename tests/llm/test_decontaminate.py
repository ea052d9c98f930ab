"""Decontamination against a plain search for word windows."""

from __future__ import annotations

import hashlib
import re

from loometry.llm.decontaminate import contamination, matches, remove_contaminated
from loometry.llm.queries import QUERIES, table

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def word_list(text):
    return WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def plain_longest(w, items, size):
    best = 0
    for _, text in items:
        v = word_list(text)
        row = [0] * (len(v) + 1)
        for x in w:
            row = [0] + [row[j] + 1 if x == y else 0 for j, y in enumerate(v)]
            top = max(row)
            if top >= min(size, len(v)) and v:
                best = max(best, top)
    return best


def plain(docs, items, size=13):
    wanted = {}
    for item_id, text in items:
        w = word_list(text)
        for i in range(max(len(w) - size + 1, 1) if w else 0):
            wanted.setdefault(tuple(w[i : i + size]), set()).add(item_id)
    out = []
    for doc_id, text in docs:
        w = word_list(text)
        hit, own = set(), set()
        for n in {len(k) for k in wanted}:
            for i in range(len(w) - n + 1):
                found = wanted.get(tuple(w[i : i + n]))
                if found:
                    hit |= set(range(i, i + n))
                    own |= found
        listed = sorted(str(i) for i in own if i is not None)
        digest = hashlib.sha256(",".join(listed).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(listed), digest, bool(hit) and 20 * len(hit) >= len(w), plain_longest(w, items, size) if hit else 0))
    return sorted(out, key=str)


def got(df):
    return sorted([tuple(r) for r in df.select("doc_id", "_found.*").collect()], key=str)


def test_query_matches_plain_search(spark, data_dir):
    docs = table(spark, data_dir, "documents").select("doc_id", "text").collect()
    items = table(spark, data_dir, "benchmark").select("item_id", "text").collect()
    rows = sorted([tuple(r) for r in QUERIES["op7_decontaminate"](spark, data_dir).collect()], key=str)
    want = plain(docs, items)
    assert rows == want and any(r[5] for r in want)


ITEMS = [(1, "one two three"), (2, " ".join(f"w{i}" for i in range(20))), (3, "One"), (4, None), (5, "..."), (12, "tie tie tie"), (None, "lonely")]
DOCS = [
    (1, "a One, TWO three four"), (2, "x " * 9 + " ".join(f"W{i}" for i in range(3, 18))), (3, None), (4, ""), (5, "two three one"),
    (6, "tie tie tie tie tie"), (6, "tie tie tie tie tie"), (None, "one"), (7, "lonely é word" + " pad" * 3), (8, "pad " * 400 + "one"),
    (9, " ".join(f"w{i}" for i in range(12))), (10, "ÀÉ x one\x00two three"),
]


def test_small_cases_with_nulls_ties_and_blocks(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = plain(DOCS, ITEMS)
    assert got(contamination(docs, items)) == want
    assert got(contamination(docs, items, block_bytes=1)) == want  # one block per item
    assert got(contamination(docs, items, block_bytes=1, pass_bytes=130)) == want  # some blocks per pass


def test_many_blocks_are_one_step(spark):
    docs = spark.createDataFrame([(i, f"say key{i} now") for i in range(300)], "doc_id long, text string")
    items = spark.createDataFrame([(i, f"key{i}") for i in range(200)], "item_id long, text string")
    judged = contamination(docs, items, block_bytes=1)
    assert judged._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert judged.filter("_found.contaminated").count() == 200


def test_shared_preambles_meet_once_and_list_all(spark):
    preamble = " ".join(f"p{i}" for i in range(40))
    items = [(i, f"{preamble} own{i}") for i in range(300)]
    docs = [(i, f"x{i} {preamble} own{i}" if i % 2 else preamble + " y") for i in range(60)]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert got(contamination(*frames)) == plain(docs, items)


def test_a_text_longer_than_a_slice(spark):
    docs = [(1, "pad " * 500_000 + "one two three"), (2, "one two three"), (3, "pad " * 10)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    items = [ITEMS[0], ITEMS[2]]
    assert got(contamination(frame, spark.createDataFrame(items, "item_id long, text string"))) == plain(docs, items)


def test_own_output_column_is_replaced(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    once = contamination(docs, items)
    assert got(contamination(once, items)) == got(once)
    assert remove_contaminated(once, items).columns == once.columns


def test_longest_matches(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS[:2], "item_id long, text string")
    found = sorted(tuple(r) for r in matches(docs, items).collect())
    assert found == [(1, 1, 1, 0, 3), (2, 2, 9, 3, 15), (10, 1, 1, 0, 3)]


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "one two three", "r", "h", 3)], "doc_id long, text string, row string, hit string, items int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert remove_contaminated(docs, items).count() == 0
    kept = remove_contaminated(docs, items.limit(0))
    assert kept.columns == docs.columns and kept.count() == 1
    assert contamination(docs.limit(0), items).count() == 0
