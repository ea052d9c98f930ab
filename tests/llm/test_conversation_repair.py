"""Repair of conversations against an exhaustive search with whole audit strings."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest

from loometry.llm import conversation_repair
from loometry.llm.conversation_repair import repair, repair_damaged, repaired_turns
from loometry.llm.queries import QUERIES, table

GOAL = re.compile(r"(s?(ua)+)?")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 0:
            continue
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if fault == 3 else 1)
    return out


def brute(rows):
    """``conv: (gaps, blank, duplicate, truncated, illegal, cost, audit, hash)``."""
    by_conv = defaultdict(list)
    for conv, *row in rows:
        row[1:] = [" " if x is None else x for x in row[1:]]
        by_conv[conv].append(row)
    out = {}
    for conv, own in by_conv.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:100], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        seen, faults = set(), []
        for _, role, text in own:
            bare = text.rstrip(" \t\n\v\f\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, *_ in own if t is not None]
        initials = [role[:1] for _, role, _ in own]
        counts = [max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")]]
        counts.append(sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])))

        @lru_cache(None)
        def best(i, said, inserted, own=own, faults=faults):
            """Least (cost, audit, turns) from row i on; ``said``: initials class so far."""
            options = []
            if i == len(own) and said in ("", "a"):
                options.append((0, "", ()))
            follow = {"": "su", "s": "u", "u": "a", "a": "u"}[said]
            for name in ("user", "assistant"):
                if name[0] in follow and inserted < 2:
                    cost, audit, turns = best(i, name[0], inserted + 1)
                    options.append((cost + 3, "I" + audit, ((name, ""), *turns)))
            if i < len(own):
                _, role, text = own[i]
                cost, audit, turns = best(i + 1, said, 0)
                options.append((cost + 4, "D" + audit, turns))
                if faults[i] in ("", "truncated"):
                    extra = 3 if faults[i] else 0
                    for price, letter, name in ((0, "K", role), (3, "R", "user"), (3, "R", "assistant")):
                        if name[:1] and name[0] in follow:
                            cost, audit, turns = best(i + 1, name[0], 0)
                            options.append((cost + price + extra, letter + audit, ((name, text), *turns)))
            return min(options, default=(10**9, "", ()))

        for i in range(len(own), -1, -200):
            best(i, "", 0)
        cost, audit, kept = best(0, "", 0)
        assert GOAL.fullmatch("".join(name[0] for name, _ in kept))
        out[conv] = (*counts, cost, audit, hashlib.sha256("\n".join(f"{a}:{b}" for a, b in kept).encode()).hexdigest())
    return out


def results(df):
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len({r[0] for r in rows})
    return {r[0]: r[1:] for r in rows}


EMPTY = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_query_matches_brute_force(spark, data_dir):
    rows = [tuple(r) for r in table(spark, data_dir, "conversations").select("conv_id", "turn", "role", "text").collect()]
    want = dict.fromkeys({r[0] for r in rows}, EMPTY) | brute(damaged(rows))
    assert results(QUERIES["op13_conversation_repair"](spark, data_dir)) == want


ROLES = ["system", "user", "assistant", "tool", "", "u", "Aid", None]
SAID = ["A.", "B!", "cut", "", " \t", None, "C?\n ", "A. "]


def made(seed, convs, longest):
    rng = random.Random(seed)
    return [
        (conv, rng.choice([None, *range(t - 2, t + 2)]), rng.choices(ROLES, [3, 9, 9, 1, 1, 1, 1, 1])[0], rng.choice(SAID) if rng.random() < 0.4 else f"{rng.random()}.")
        for conv in [None, *range(convs)] for t in range(rng.randint(1, longest))
    ]


@pytest.mark.parametrize(("seed", "convs", "longest", "part_rows"), [(1, 150, 9, 50_000), (2, 30, 40, 7), (3, 3, 150, 20)])
def test_random_conversations_in_pieces(spark, monkeypatch, seed, convs, longest, part_rows):
    monkeypatch.setattr(conversation_repair, "PART_ROWS", part_rows)
    rows = made(seed, convs, longest)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, pos int")
    assert results(repair(df)) == brute(rows)
    want = dict.fromkeys({r[0] for r in rows}, EMPTY) | brute(damaged(rows))
    assert results(repair_damaged(df)) == want


def test_one_row_repeated_fills_many_pieces(spark, monkeypatch):
    monkeypatch.setattr(conversation_repair, "PART_ROWS", 10)
    rows = [(1, None, "user", "same.")] * 100 + [(1, 5, "assistant", "x" * 100_000 + ".")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = results(repair(df))
    assert got == brute(rows) and got[1][2] == 99


def test_turns_after_repair(spark):
    rows = [(1, 0, "system", "S."), (1, 1, "user", "Q?"), (1, 3, "user", "A."), (2, 0, "tool", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    kept = repaired_turns(df).orderBy("conv_id", "piece", "place").collect()
    assert [(r.conv_id, r.role, r.text) for r in kept] == [(1, "system", "S."), (1, "user", "Q?"), (1, "assistant", "A.")]


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert results(repair_damaged(df)) == {} and repaired_turns(df).count() == 0
