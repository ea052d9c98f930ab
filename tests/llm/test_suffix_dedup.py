"""Removal of earlier byte strings against a plain search."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from loometry.llm import repeats
from loometry.llm.queries import QUERIES, table
from loometry.llm.suffix_dedup import remove_earlier, window_classes


def plain(docs, size=50):
    split = [(float("inf") if i is None else i, i, (t or "").encode()) for i, t in docs]
    least = {}
    for key, _, b in split:
        for i in range(len(b) - size + 1):
            s = b[i : i + size]
            if least.get(s, float("inf")) > key:
                least[s] = key
    out = []
    for key, doc_id, b in split:
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if least.get(b[i : i + size], float("inf")) < key:
                gone[i : i + size] = b"\x01" * size
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc_id, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_query_matches_plain_search(spark, data_dir):
    docs = [tuple(r) for r in table(spark, data_dir, "documents").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in QUERIES["op2_suffix_dedup"](spark, data_dir).collect()), key=str)
    want = plain(docs)
    assert got == want and sum(r[2] for r in want) > 0


def test_classes_are_those_of_equal_strings():
    rng = np.random.default_rng(4)
    for letters in (1, 2, 4):
        for n in (50, 51, 60, 333, 3000):
            raw = rng.integers(97, 97 + letters, n).astype(np.uint8)
            raw[n // 2 :] = raw[: n - n // 2]
            windows = np.arange(n - 49)
            windows = windows[rng.random(len(windows)) < 0.8] if n > 60 else windows
            got = window_classes(raw, windows)
            data = raw.tobytes()
            names = {}
            want = [names.setdefault(data[i : i + 50], len(names)) for i in windows.tolist()]
            pairs = set(zip(want, got.tolist(), strict=True))
            assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)

    def some(n):
        return "".join(rng.choice("abcdé 日") for _ in range(n))

    passages = [some(n) for n in (25, 40, 60, 90, 200, 400)]
    docs = []
    for i in range(120):
        t = some(rng.randrange(0, 150))
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(passages)
            at = rng.randrange(0, len(t) + 1)
            t = t[:at] + p[rng.randrange(0, len(p) // 3 + 1) :] + t[at:]
        docs.append(((i * 37) % 120, t))
    docs += [(500, "ab" * 200), (501, None), (502, ""), (503, "ab" * 100), (504, docs[3][1]), (504, docs[3][1]), (None, passages[5]), (None, passages[4]), (505, "x" * 49), (506, "x" * 50), (507, "x" * 50)]
    return docs


@pytest.mark.parametrize("many", [4096, 2, 0])
def test_passages_loops_copies_and_hot_minimisers(spark, texts, many, monkeypatch):
    monkeypatch.setattr(repeats, "MANY", many)
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    got = remove_earlier(docs).select("doc_id", "_kept.n_bytes", "_kept.n_removed", "_kept.n_spans", "_kept.sha256").collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(texts)


def test_clashing_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b", "k", 2)], "doc_id long, text string, key string, found int")
    out = remove_earlier(docs)
    assert out.columns == [*docs.columns, "_kept"] and out.first()["_kept"]["text"] == "a b"
    assert remove_earlier(docs.limit(0)).count() == 0


def colliding(passage):
    """A text that holds the passage and one that shares nothing with it, whose SHA-256
    agree in 32 bits."""
    def short(text):
        return hashlib.sha256(text.encode()).digest()[:4]

    holders = {short(f"{passage} {i}"): f"{passage} {i}" for i in range(200_000)}
    words = " ".join(f"other{i}" for i in range(45))
    for i in range(200_000):
        text = f"{words} {i}"
        if short(text) in holders:
            return holders[short(text)], text
    raise AssertionError("no collision found")


def test_texts_without_or_with_repeated_ids_keep_apart(spark):
    from loometry.llm.substring_dedup import remove_repeats

    passage = " ".join(f"word{i}" for i in range(40))
    holder, innocent = colliding(passage)
    for doc_id in (None, 5):
        docs = spark.createDataFrame([(1, passage), (doc_id, holder), (doc_id, innocent)], "doc_id long, text string")
        for kept in (remove_earlier(docs), remove_repeats(docs)):
            gone = {r.text: r._kept.n_removed for r in kept.collect()}
            assert gone[innocent] == 0 and gone[holder] > 0


def test_no_judge_gets_a_whole_family(spark, monkeypatch):
    """A passage that many documents of one slice share is judged in small parts."""
    from loometry.llm.suffix_dedup import K, LENGTH, byte_symbols, later_windows

    rng = random.Random(3)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(70))
    flank = lambda: "".join(rng.choice("abcdefgh ") for _ in range(40))
    rows = [(i, f"{flank()}{passage}{flank()}") for i in range(1500)]

    def judge(bucket):
        if len(bucket.raw) > 30_000:
            raise AssertionError(f"{len(bucket.raw)} bytes judged at once")
        return later_windows(bucket)

    monkeypatch.setattr(repeats, "MANY", 100)
    monkeypatch.setattr(repeats, "JUDGE_BYTES", 10_000)
    scheme = repeats.Scheme(LENGTH, K, False, byte_symbols, judge)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = repeats.repeated_windows(docs, scheme)
    assert found.filter("found is not null").count() == 1499
