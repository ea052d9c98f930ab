"""The pipeline, stage by stage, against brute force."""

from __future__ import annotations

import hashlib

import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from loometry.llm.queries import table
from loometry.llm.toxicity import toxicity
from tests.llm.test_decontaminate import plain as plain_contamination
from tests.llm.test_minhash import SPACE
from tests.llm.test_suffix_dedup import plain as plain_removal


def groups(docs, size=5, percent=80):
    """Smallest id of each group of near-duplicates, by all pairs that share a shingle."""
    sets = {}
    for doc_id, text in docs:
        w = SPACE.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
        sets[doc_id] = {tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))} if w else set()
    holders, common = {}, {}
    for doc_id, own in sets.items():
        for s in own:
            for other in holders.setdefault(s, []):
                common[other, doc_id] = common.get((other, doc_id), 0) + 1
            holders[s].append(doc_id)
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    return {root(i) for i in sets}


@pytest.fixture(scope="module")
def stages(spark, data_dir, tmp_path_factory):
    """What goes into each stage and what comes out."""
    folder = tmp_path_factory.mktemp("stages")
    docs, seen = table(spark, data_dir, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, data_dir)
        out.write.parquet(f"{folder}/{name}")
        out = spark.read.parquet(f"{folder}/{name}")
        seen.append((docs, out))
        docs = out
    return seen


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_all_but_the_last_keep_the_columns(stages):
    for given, out in stages[:-1]:
        assert out.dtypes == given.dtypes
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeated_strings", "benchmark_passages", "piece_ids"]


def test_toxic_documents_go(spark, data_dir, stages):
    given, out = stages[0]
    rejected = {r.doc_id for r in toxicity(given, table(spark, data_dir, "labels")).filter("_toxicity.rejected").collect()}
    assert sorted(pairs(out)) == sorted((i, t) for i, t in pairs(given) if i not in rejected)


def test_one_near_duplicate_stays(stages):
    given, out = stages[1]
    keep = groups(pairs(given))
    assert sorted(pairs(out)) == sorted((i, t) for i, t in pairs(given) if i in keep)


def test_repeated_strings_go(stages):
    given, out = stages[2]
    left = dict(pairs(out))
    for doc_id, n_bytes, n_removed, _, digest in plain_removal(pairs(given)):
        if not n_removed:
            assert doc_id in left and hashlib.sha256((left[doc_id] or "").encode()).hexdigest() == digest
        elif doc_id in left:
            assert 0 < len(left[doc_id].encode()) <= n_bytes - n_removed
    assert all(r.n_chars == len(r.text or "") for r in out.collect())


def test_contaminated_documents_go(spark, data_dir, stages):
    given, out = stages[3]
    items = [tuple(r) for r in table(spark, data_dir, "benchmark").select("item_id", "text").collect()]
    keep = {r[0] for r in plain_contamination(pairs(given), items) if not r[5]}
    assert {i for i, _ in pairs(out)} == keep


def test_ids_are_the_librarys(stages):
    given, out = stages[4]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {i: library.encode(t or "") for i, t in pairs(given)}
    assert {r.doc_id: r.ids for r in out.collect()} == want and all(r.round_trip for r in out.collect())


def test_run_is_all_stages(spark, data_dir, stages):
    assert sorted(corpus_pipeline.run(spark, data_dir).collect()) == sorted(stages[-1][1].collect())


def test_worker_memory_is_bounded(spark, monkeypatch):
    """Slices have small tables of powers, and a text goes to a worker once."""
    from loometry.llm import arrays, repeats, toxicity

    assert all((size + 1).bit_length() <= 19 for size in (arrays.SLICE_BYTES, repeats.SLICE_BYTES))
    seen, kind = [], type(spark.range(1))
    real = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda df, *a, **k: (seen.append(df.schema), real(df, *a, **k))[1])
    docs = spark.createDataFrame([(1, "a b", "x"), (2, None, "y")], "doc_id long, text string, lang string")
    model = toxicity.Model(toxicity.np.zeros(0, toxicity.U64), toxicity.np.zeros(0), toxicity.np.full(1, 30.0))
    got = toxicity.score(docs, model).select("doc_id", "text", "lang").collect()
    assert sorted(map(tuple, got)) == [(1, "a b", "x"), (2, None, "y")]
    assert sum(f.name == "text" for s in seen for f in s) == 1 and "text" not in seen[0]["row"].dataType.names
