"""Near-duplicate components against all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from loometry.llm.minhash import near_duplicates, remove_near_duplicates
from loometry.llm.queries import QUERIES, table

SPACE = re.compile(rb"[^\x20\x09-\x0D]+")


def set_of(text):
    w = SPACE.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return {tuple(w[i : i + 3]) for i in range(max(len(w) - 2, 1))} if w else set()


def plain(docs):
    sets = [(i, set_of(t)) for i, t in docs]
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    by = {}
    for k, (i, s) in enumerate(sets):
        if i is not None:
            for x in s:
                by.setdefault(x, []).append(k)
    common = {}
    for own in by.values():
        for n, a in enumerate(own):
            for b in own[n + 1 :]:
                common[a, b] = common.get((a, b), 0) + 1
    for (a, b), n in common.items():
        if 100 * n >= 85 * (len(sets[a][1]) + len(sets[b][1]) - n):
            up[root(a)] = root(b)
    low = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            low[root(k)] = min(low.get(root(k), i), i)
    return sorted(((i, len(s), low.get(root(k)), i == low.get(root(k))) for k, (i, s) in enumerate(sets)), key=str)


def test_query_matches_all_pairs(spark, data_dir):
    docs = [tuple(r) for r in table(spark, data_dir, "documents").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in QUERIES["op10_minhash"](spark, data_dir).collect()), key=str)
    assert got == plain(docs)


@pytest.fixture(scope="module")
def family():
    rng = random.Random(5)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    docs = []
    for i in range(150):
        copy = list(base)
        for _ in range(rng.choice([0, 0, 1, 2, 3, 4, 6, 9])):
            copy[rng.randrange(120)] = f"x{rng.randrange(9999)}"
        docs.append((1000 - 3 * i, " ".join(copy).upper() if i % 7 == 0 else "  ".join(copy)))
    chain = [f"c{i}" for i in range(200)]
    for step in range(25):  # neighbours are alike, the ends are not
        docs.append((2000 + step, " ".join(chain[4 * step : 4 * step + 100])))
    docs += [(5, ""), (6, None), (7, "one"), (8, "ONE"), (9, "one two"), (10, "one  two"), (11, "one two three"), (11, "one two three"), (12, " ")]
    return docs


def test_families_chains_and_short_texts(spark, family):
    docs = spark.createDataFrame(family, "doc_id long, text string").repartition(7)
    got = near_duplicates(docs).selectExpr("doc_id", "n", "component_id", "doc_id = component_id").collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(family)


def test_one_of_each_group_stays(spark, family):
    rows = [(i, t, "r", 1) for i, t in family] + [(None, "nobody here now", "r", 2), (None, None, "r", 3), (7, "other words entirely", "r", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, d1 int")
    kept = remove_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    groups = {c for i, n, c, _ in plain(family) if n}
    assert ids == sorted([*groups, 5, 6, 12, None, None, 7], key=str)
    assert remove_near_duplicates(docs.limit(0)).count() == 0


def test_estimate_follows_similarity():
    from loometry.llm.minhash import fine_signatures, signatures

    rng = np.random.default_rng(2)
    x = np.sort(rng.integers(0, 1 << 63, 2000).astype(np.uint64))
    for share in (0.5, 0.85):
        n = round(2000 * share)
        y = np.sort(np.concatenate([x[:n], rng.integers(0, 1 << 63, 2000 - n).astype(np.uint64)]))
        for make, off in ((signatures, 0.15), (fine_signatures, 0.06)):
            sig = make(np.concatenate([x, y]), np.array([0, 2000, 4000]))
            differ = np.unpackbits(sig[0] ^ sig[1]).sum()
            assert abs(1 - 2 * differ / (8 * sig.shape[1]) - n / (4000 - n)) < off


def test_estimates_of_short_texts_keep_links(spark):
    """Pairs at the threshold of 4 to 20 shingles: none is below the cut."""
    from loometry.llm import minhash

    rng = np.random.default_rng(3)
    for percent, sizes in ((85, ((6, 7), (7, 8), (12, 14), (17, 20))), (80, ((4, 5), (8, 10), (12, 15), (16, 20)))):
        for small, large in sizes:
            x = rng.integers(0, 1 << 63, (1500, large)).astype(np.uint64) << np.uint64(1)
            sets = np.concatenate([part for row in x for part in (np.sort(row[:small]), np.sort(row))])
            cuts = np.concatenate([[0], np.cumsum(np.tile([small, large], len(x)))])
            packed = minhash.fine_signatures(sets, cuts)
            differ = np.unpackbits(packed[0::2] ^ packed[1::2], axis=1).sum(1)
            found = 1 - 2 * differ / minhash.FINE
            assert found.std() < 1.15 * np.sqrt((1 - (small / large) ** 2) / minhash.FINE)
            pair = spark.createDataFrame([(small, large)], "na long, nb long")
            cut = pair.select(minhash.fine_cut("na", "nb", percent)).first()[0]
            assert percent / 100 - 0.1 < cut < small / large
            assert found.min() >= cut


def test_short_families_around_a_third_text(spark):
    """Two linked texts of 6 to 20 shingles in each family, among many that are alike
    but linked with nothing, so that a bucket's centre is nearly always one of those."""
    docs = []
    for family in range(140):
        size = (6, 6, 6, 7, 12, 20)[family % 6]
        core = [f"f{family}w{i}" for i in range(size + 2)]
        more = {6: 1, 7: 1, 12: 2, 20: 3}[size]
        texts = [core, core + [f"f{family}e{i}" for i in range(more)]]
        for other in range(36):
            texts.append([f"f{family}o{other}x{i}" for i in range(more + 1)] + core)
        docs += [(1000 * family + i, " ".join(t)) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    got = near_duplicates(frame).selectExpr("doc_id", "n", "component_id", "doc_id = component_id").collect()
    want = plain(docs)
    assert sum(not kept for _, _, _, kept in want) == 140
    assert sorted((tuple(r) for r in got), key=str) == want
