from __future__ import annotations

import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from loometry import fixed
from loometry.functions import review, text
from loometry.operators import localization as loc

SEG = "briefing_id long, segment_index int, block string, field string, label string, char_limit int, text string"


def segments(spark, *texts, briefing=1):
    return spark.createDataFrame([(briefing, i, None, f"f{i}", f"f{i}", None, t) for i, t in enumerate(texts)], SEG)


def hits(spark, texts, terms):
    seg = segments(spark, *texts)
    tf = spark.createDataFrame([(i, "NL", t, "x") for i, t in enumerate(terms)], "id long, language string, source string, target string")
    markets = spark.createDataFrame([(1, "NL")], "briefing_id long, market string")
    return {r["term_id"] for r in loc.term_hits(seg, tf, markets, rows=2).collect()}


def brute(texts, terms):
    joined = " \n ".join(t for t in texts if t).lower()
    return {i for i, t in enumerate(terms) if t and t.lower() in joined}


def test_term_hits_cases(spark):
    texts = ["The quick Brown fox", "", "jumps over", "the lazy\tdog"]
    terms = [
        "quick", "ick bro", "OVER", "cat", "fox \n jumps", "x \n jumps over \n th", "over \n", "\n", " ", "lazy\td",
        "fox ", " the", "quick fox", "", "o",
    ]
    assert hits(spark, texts, terms) == brute(texts, terms)


def test_term_hits_random(spark):
    rng = random.Random(5)
    alphabet = "ab \n"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 9))) for _ in range(25)]
    terms = list({"".join(rng.choice(alphabet) for _ in range(rng.randint(1, 6))) for _ in range(120)})
    assert hits(spark, texts, terms) == brute(texts, terms)


def test_relevant_terms_keeps_the_first_per_market(spark):
    seg = segments(spark, "aaa bbb")
    terms = spark.createDataFrame(
        [(i, "NL" if i % 2 else "FR", "aaa", str(i)) for i in range(10)], "id long, language string, source string, target string"
    )
    markets = spark.createDataFrame([(1, "NL"), (1, "FR"), (2, "NL")], "briefing_id long, market string")
    got = loc.relevant_terms(seg, terms, markets, n=2).collect()
    assert sorted((r["market"], r["rank"], r["term_id"]) for r in got) == [("FR", 1, 0), ("FR", 2, 2), ("NL", 1, 1), ("NL", 2, 3)]


def test_glossary_grid(spark):
    rows = [
        (0, 0, ["Title"]), (0, 1, ["en", "NOR", "x", "nl", "NL"]), (0, 2, ["cat", "katt", "", "old", "kat"]),
        (0, 3, ["cat", "again", "", "", "poes"]), (0, 4, ["", "a", "", "", "b"]), (0, 5, ["dog", "dog", "", "", ""]),
        (0, 6, ["dog"]),
        (1, 0, ["EN", "NO"]), (1, 1, ["cat", "pus"]),
        (2, 0, ["no", "header"]), (2, 1, ["cat", "lost"]),
        (3, 8, ["EN", "NO"]), (3, 9, ["late", "header"]),
    ]
    grid = spark.createDataFrame(rows, "sheet_idx int, row_idx long, cells array<string>")
    got = {(r["market"], r["source"]): r["target"] for r in loc.glossary_from_grid(grid).collect()}
    # Last column of a market, first row in a sheet, last sheet over all.
    assert got == {("NO", "cat"): "pus", ("NL", "cat"): "kat"}


def test_copy_sheet(spark):
    rows = [
        (0, ["Block", "Field", "EN"]), (1, ["noise", "x", "y"]),
        (2, ["Request nr. 1"]), (3, ["Email", "", "spring"]), (4, ["Notes", "in column B"]), (5, ["Hero", "Title (MAX 40 chars)", "Hi"]),
        (6, ["", "Text (a) (b)", ""]), (7, ["Footer"]), (8, ["", "", "no label"]), (9, ["", "Link", "go"]),
        (10, ["REQUEST  NR 2"]), (11, ["", "Title", "Yo"]), (12, ["email", "second", ""]), (13, ["Email", "third"]),
    ]
    grid = spark.createDataFrame([("S", i, c) for i, c in rows], "sheet string, row_idx long, cells array<string>")
    marked = loc.sheet_requests(grid, rows=3)
    seg = loc.request_segments(marked, grid, chunk_rows=2).orderBy("request_index", "segment_index").collect()
    assert [(r["request_index"], r["segment_index"], r["block"], r["field"], r["char_limit"], r["text"]) for r in seg] == [
        (0, 0, "Hero", "Title", 40, "Hi"), (0, 1, "Hero", "Text", None, ""), (0, 2, "Footer", "Link", None, "go"),
        (1, 0, None, "Title", None, "Yo"),
    ]
    meta = {r["request_index"]: r for r in loc.request_metadata(marked, grid).collect()}
    assert (meta[0]["name"], meta[0]["email"], meta[0]["notes"], meta[0]["due"]) == ("spring", "spring", "in column B", None)
    assert (meta[1]["name"], meta[1]["request_label"]) == ("third", "REQUEST  NR 2")
    filled = {r["request_index"]: r["filled"] for r in loc.filled_segments(marked, loc.request_segments(marked, grid)).collect()}
    assert filled == {0: 2, 1: 1}


def test_export(spark, tmp_path):
    seg = spark.createDataFrame(
        [(1, 0, "A", "f", "F", None, "one"), (1, 1, "A", "f", "F", None, "two"), (1, 2, None, "f", "F", None, "three"),
         (1, 3, "A", "f", "F", None, "four"), (2, 0, "A", "f", "F", None, "other")], SEG)
    tr = spark.createDataFrame([(1, "NL", 0, "een"), (1, "NL", 2, "drie")], "briefing_id long, market string, segment_index int, text string")
    grid = loc.export_grid(seg, tr, ["NL", "FR"], rows=1)
    rows = [tuple(r) for r in grid.orderBy("briefing_id", "segment_index").collect()]
    assert rows == [
        (1, 0, "A", "F", "one", "een", None), (1, 1, "", "F", "two", "", None), (1, 2, "", "F", "three", "drie", None),
        (1, 3, "A", "F", "four", "", None), (2, 0, "A", "F", "other", None, None),
    ]
    meta = spark.createDataFrame(
        [(1, "N", "e", None, None, "d", ""), (3, None, None, None, None, None, None)],
        "briefing_id long, name string, email string, requestor string, date_email string, due string, notes string",
    )
    head = loc.export_head(meta).filter("briefing_id = 1")
    assert [(r["label"], r["value"]) for r in head.orderBy("line").collect()] == [("N", ""), ("Email", "e"), ("Due", "d")]
    sheet = loc.export_sheet(meta, seg.filter("briefing_id = 1"), tr, rows=1)
    want = [
        (1, ["", "", "EN", "NL"]), (1, ["N"]), (1, ["Email", "", "e"]), (1, ["Due", "", "d"]), (1, []), (1, ["A", "F", "one", "een"]),
        (1, ["", "F", "two", ""]), (1, ["", "F", "three", "drie"]), (1, ["A", "F", "four", ""]), (3, ["", "", "EN"]), (3, [None]), (3, []),
    ]
    assert [(r.briefing_id, r.cells) for r in sheet.orderBy("briefing_id", "part", "line").collect()] == want
    loc.write_export(sheet, str(tmp_path / "out"))
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert back.columns[:6] == ["briefing_id", "part", "line", "c0", "c1", "c2"] and back.count() == len(want)


def test_rare_grams_find_what_contains_does(spark):
    import random
    import time

    rng = random.Random(6)
    words = ["".join(rng.choices("abcé\U0001f642", k=rng.randint(1, 12))) for _ in range(400)] + ["\n \t", " "]
    anchors = [rng.choice(words)[rng.randint(0, 3):][: rng.randint(1, 6)] or "a" for _ in range(80)] + ["zzz", "zz", "\n ", "*.", "abc"]
    long = "ab" * 500_000 + "needle" + "ba" * 100
    vocabulary = spark.createDataFrame([(w,) for w in {*words, long}], "word string")
    listed = spark.createDataFrame([(a,) for a in {*anchors, "needle"}], "anchor string")
    start = time.monotonic()
    got = {(r.word, r.anchor) for r in loc._containing(vocabulary, listed).collect()}
    assert got == {(w, a) for w in {*words, long} for a in {*anchors, "needle"} if a in w}
    assert time.monotonic() - start < 60
    assert loc._containing(vocabulary, listed.limit(0)).count() == 0


def test_content_hash(spark):
    df = spark.createDataFrame([(" Title\t", "Hello ", None), ("Title", "Hello", "")], "f string, s string, t string")
    got = {r[0] for r in df.select(review.content_hash(F.col("f"), F.col("s"), F.col("t"))).collect()}
    assert got == {hashlib.sha256("Title\x01Hello\x01".encode()).hexdigest()}


def test_strip_takes_all_white_space(spark):
    df = spark.createDataFrame([(fixed.WHITESPACE + "a b" + fixed.WHITESPACE,)], "s string")
    assert df.select(text.strip(F.col("s"))).first()[0] == "a b"


def test_link_status(spark):
    now = dt.datetime(2024, 5, 1)
    past, future = now - dt.timedelta(days=1), now + dt.timedelta(days=1)
    rows = [(None, None, future, "none"), ("", None, future, "none"), ("h", past, future, "revoked"), ("h", None, past, "expired"),
            ("h", None, now, "expired"), ("h", None, None, "expired"), ("h", None, future, "active"), (None, past, past, "none")]
    df = spark.createDataFrame(rows, "h string, r timestamp, e timestamp, want string")
    got = df.select(review.link_status(F.col("h"), F.col("r"), F.col("e"), F.lit(now)).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got)


def test_drift_and_public_view(spark):
    seg = segments(spark, "hello", "bye")
    tr = spark.createDataFrame(
        [(1, "NL", 0, "hallo"), (1, "FR", 0, "salut")], "briefing_id long, market string, segment_index int, text string"
    )
    same = hashlib.sha256("f0\x01hello\x01hallo".encode()).hexdigest()
    tickets = spark.createDataFrame(
        [(1, 1, "NL", 0, same), (2, 1, "NL", 0, "old"), (3, 1, "NL", 1, None), (4, 1, "NL", 9, "old"), (5, 1, "NL", 1, "old")],
        "id long, briefing_id long, market string, segment_index int, content_hash string",
    )
    got = {r["id"]: r["item_changed"] for r in loc.flag_changed(tickets, seg, tr).collect()}
    assert got == {1: False, 2: True, 3: False, 4: False, 5: True}
    asked = spark.createDataFrame([(1, "NL")], "briefing_id long, market string")
    shown = loc.public_items(seg, tr, asked).orderBy("segment_index").collect()
    assert [r["translation"] for r in shown] == ["hallo", ""]
    assert "salut" not in str(shown) and "meta" not in shown[0].asDict()


def test_replies(spark):
    seg = segments(spark, "one", " ", "two", "three")
    reply = 'Sure:\n```json\n{"0": " een ", "1": null, "2": "drie"}\n```'
    replies = spark.createDataFrame([(1, "NL", reply), (1, "FR", "no object here")], "briefing_id long, market string, reply string")
    got = {(r["market"], r["segment_index"]): r["text"] for r in loc.apply_replies(seg, replies, rows=2).collect()}
    assert [got["NL", i] for i in range(4)] == ["een", "", "two", "drie"]
    assert [got["FR", i] for i in range(4)] == ["one", "", "two", "three"]


def test_prompt_text(spark):
    seg = spark.createDataFrame([(1, 0, "Hero", "Title", "T", 40, "Hi"), (1, 1, None, "Body", "B", None, ""), (1, 2, None, "Link", "L", None, "go")], SEG)
    markets = spark.createDataFrame([(1, "NL"), (2, "NL")], "briefing_id long, market string")
    terms = spark.createDataFrame([(1, "NL", 1, "hi", "hoi")], "briefing_id long, market string, rank int, source string, target string")
    lines = loc.prompt_lines(seg, markets, terms, rows=1)
    whole = loc.assemble(lines, ["briefing_id", "market"], ["part", "line"]).collect()
    assert [r["briefing_id"] for r in whole] == [1]
    got = whole[0]["text"].split("\n")
    assert got[0].endswith("from English into Dutch (Netherlands).")
    assert got[6:8] == [fixed.PROMPT_GLOSSARY, '    "hi" -> "hoi"']
    assert got[-3:] == [fixed.PROMPT_ITEMS, "0. [Hero/Title (max 40 chars)]: Hi", "1. [Link]: go"]


@pytest.mark.parametrize("name, body, index, error", [
    (" Ann ", " ok ", 0, None), (" ", "ok", 0, "name"), ("Ann", "\t", 0, "name"), ("Ann", "ok", 5, "range"), ("Ann", "ok", -1, "range"),
])
def test_ticket_checks(spark, name, body, index, error):
    drafts = spark.createDataFrame(
        [(1, 1, "NL", index, name, body)], "id long, briefing_id long, market string, segment_index int, author_name string, body string"
    )
    tr = spark.createDataFrame([], "briefing_id long, market string, segment_index int, text string")
    row = loc.check_tickets(drafts, segments(spark, "hello"), tr).first()
    assert (row["error"] is None) if error is None else (error in row["error"])
    assert (row["status"] == "open") == (error is None) and (row["content_hash"] is not None) == (error is None)
