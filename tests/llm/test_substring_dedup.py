"""Repeated word windows against a plain count."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest

from loometry.llm import repeats
from loometry.llm.queries import QUERIES, table
from loometry.llm.substring_dedup import remove_repeats

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def plain(docs, size=35):
    split = [(i, WORD.findall((t or "").encode())) for i, t in docs]
    count = Counter(tuple(w[i : i + size]) for _, w in split for i in range(len(w) - size + 1))
    out = []
    for doc_id, w in split:
        gone = set()
        for i in range(len(w) - size + 1):
            if count[tuple(w[i : i + size])] > 1:
                gone |= set(range(i, i + size))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_query_matches_plain_count(spark, data_dir):
    docs = [tuple(r) for r in table(spark, data_dir, "documents").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in QUERIES["op5_substring_dedup"](spark, data_dir).collect()), key=str)
    want = plain(docs)
    assert got == want and sum(r[2] for r in want) > 0


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)

    def some(n):
        return [rng.choice("abcdefghij") * rng.randrange(1, 4) + str(rng.randrange(60)) for _ in range(n)]

    passages = [some(n) for n in (35, 36, 50, 90, 34, 200)]
    docs = []
    for i in range(120):
        w = some(rng.randrange(0, 80))
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(passages)
            at = rng.randrange(0, len(w) + 1)
            cut = rng.randrange(0, len(p) // 3 + 1)
            w[at:at] = p[cut:]
        docs.append((i, rng.choice([" ", "\n", "  "]).join(w)))
    loop = some(7) * 30
    docs += [(500, " ".join(loop)), (501, None), (502, ""), (503, "é " * 40), (504, docs[3][1]), (504, docs[3][1]), (505, docs[4][1].replace(" ", "\t"))]
    docs += [(None, " ".join(passages[3])), (506, " ".join(["same"] * 36)), (507, " ".join(["only"] * 35))]
    return docs


@pytest.mark.parametrize("many", [4096, 2, 0])
def test_passages_loops_copies_and_hot_minimisers(spark, texts, many, monkeypatch):
    monkeypatch.setattr(repeats, "MANY", many)
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    got = remove_repeats(docs).select("doc_id", "_kept.n_words", "_kept.n_removed", "_kept.sha256").collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(texts)


def test_clashing_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b", "k", 2)], "doc_id long, text string, key string, found int")
    out = remove_repeats(docs)
    assert out.columns == [*docs.columns, "_kept"] and out.first()["_kept"]["text"] == "a b"
    assert remove_repeats(docs.limit(0)).count() == 0
