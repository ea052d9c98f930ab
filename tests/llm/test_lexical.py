"""Ranked search against brute force; the whole query is compared with SQL."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from loometry.llm import lexical
from loometry.llm.lexical import rank

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute(docs, items, k=10):
    held = [(d, Counter(terms(t))) for d, t in docs]
    N, L = sum(1 for _, c in held if c), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in held:
            n = sum(c.values())
            score = sum(
                math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * (10 + 90 * n * N // L)))
                for t in set(terms(text)) if c[t]
            )
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(item, r, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def ranked(spark, docs, items, **options):
    parts = options.pop("parts", 3)
    d = spark.createDataFrame([(*r, "x", 0) for r in docs], "doc_id long, text string, item_id string, score int").repartition(parts)
    i = spark.createDataFrame([(*r, "y") for r in items], "item_id long, text string, doc_id string")
    return sorted([tuple(r) for r in rank(d, i, **options).collect()], key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_texts(spark, monkeypatch, seed):
    """Frequent and rare terms, several slices, walks and blocks of queries."""
    monkeypatch.setattr(lexical, "WALK", 16)
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    docs = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(0, 60)))) for i in range(1500)]
    docs += [(i + 5000, docs[7][1]) for i in range(30)]
    items = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 25)))) for i in range(25)]
    want = brute(docs, items)
    assert ranked(spark, docs, items, parts=2) == want
    assert ranked(spark, docs, items, block_bytes=300) == want


def test_nulls_ties_repeats_and_odd_texts(spark):
    docs = [
        (None, "red fox"), (None, "red fox"), (4, "red fox"), (4, "red fox"), (3, "RED-fox"), (1, None), (2, ""), (9, " .,;"),
        (5, "été Été 123 a1b2"), (6, "x" * 200_000 + " fox"), (7, "fox " * 50_000), (8, "long \U0001f642　word"),
    ] + [(100 + i, "filler words here") for i in range(40)]
    items = [(1, "Fox red red"), (2, None), (3, ""), (None, "ÉTÉ été A1B2"), (5, "absent"), (6, "fox"), (6, "red"), (7, "\U0001f642　word")]
    assert ranked(spark, docs, items) == brute(docs, items)


def test_every_document_holds_the_term(spark):
    docs = [(i, "same words") for i in range(2000)]
    assert ranked(spark, docs, [(1, "same")]) == brute(docs, [(1, "same")]) == []


def test_empty_tables(spark):
    assert ranked(spark, [], [(1, "a")]) == [] and ranked(spark, [(1, "a")], []) == [] and ranked(spark, [(1, None)], [(1, "a")]) == []
