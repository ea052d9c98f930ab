"""The token store against whole-text encoding, and its index."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from loometry.llm.queries import QUERIES, table
from loometry.llm.token_store import PerfectHash, digests, fetch, key_hash, locate, write
from loometry.session import shared_dir

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(FILE)


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def test_query_matches_whole_text_encoding(spark, data_dir, tokenizer):
    start, want = 0, []
    for r in table(spark, data_dir, "documents").orderBy("doc_id").collect():
        ids = ids_of(tokenizer, r.text)
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in QUERIES["op1_token_store"](spark, data_dir).collect()) == want


TEXTS = [
    "", None, " ", "a", "a b", "a  b", "a   b  ", "  a", "a \n b", "a\n b", "a b  c", "x 　y", "it's we'll 's 'S", "12 345 6th",
    "é ö 日本 語", "<|endoftext|> x<|endoftext|>", "tab\tand\r\nline", "…!? -- a-b", "end ", " start", "a  b", "word " * 500, "x" * 3000, "🙂 🙂🙂",
]


def test_odd_texts_repeats_and_nulls(spark, tokenizer):
    rows = [(i, t, "k") for i, t in enumerate(TEXTS)] + [(3, "a", "k"), (3, "other", "k"), (None, "nobody", "k"), (None, None, "k"), (-5, "minus", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    path = shared_dir(spark, "tokens")
    write(docs, FILE, path)
    got = digests(docs, path).collect()
    want = sorted((str(i), len(ids_of(tokenizer, t)), zlib.crc32(np.array(ids_of(tokenizer, t), "<u4").tobytes())) for i, t, _ in rows)
    assert sorted((str(r.key), r.n_tokens, r.ids_crc32) for r in got) == want
    order = sorted(got, key=lambda r: r.start)
    ends = np.cumsum([r.n_tokens for r in order]).tolist()
    assert [r.start for r in order] == [0, *ends[:-1]]
    keys = [r.key for r in order]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    wanted = spark.createDataFrame([(7,), (99,), (None,), (8,), (10**15,)], "doc_id long")
    found = {r.key: r.ids for r in fetch(wanted, path).collect()}
    assert set(found) == {7, 8, None} and found[7] == ids_of(tokenizer, TEXTS[7])
    assert {r.key: r.copies for r in locate(docs, path).collect()}[3] == 3


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    path = shared_dir(spark, "tokens")
    write(docs, FILE, path)
    assert digests(docs, path).count() == 0 and fetch(docs, path).count() == 0


def test_perfect_hash_is_minimal():
    hashes = key_hash(np.arange(50000) * 7, np.zeros(50000, bool))
    hashed = PerfectHash.build(hashes)
    assert sorted(hashed.slots(hashes).tolist()) == list(range(50000))
    assert hashed.sizes.sum() < 50000 * 4


def test_the_answer_follows_the_index(spark, tokenizer):
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(50)] + [(7, f"again {i}") for i in range(30)], "doc_id long, text string")
    path = shared_dir(spark, "tokens")
    write(docs, FILE, path)
    right = {(r.key, r.start): (r.n_tokens, r.ids_crc32) for r in digests(docs, path).collect()}
    assert len(right) == 80 and sum(k == 7 for k, _ in right) == 31
    assert [r.start for r in digests(docs.filter("doc_id = 7"), path).orderBy("start").collect()] == sorted(s for k, s in right if k == 7)

    def moved(batches):
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                row["lengths"] = (np.frombuffer(row["lengths"], "<u4") - 1).astype("<u4").tobytes()
            yield pa.RecordBatch.from_pylist(rows, batch.schema)

    wrong = shared_dir(spark, "tokens")
    spark.read.parquet(f"{path}/payload").write.parquet(f"{wrong}/payload")
    index = spark.read.parquet(f"{path}/index")
    index.mapInArrow(moved, index.schema).write.parquet(f"{wrong}/index")
    told = {r.key: (r.n_tokens, r.ids_crc32) for r in digests(docs.filter("doc_id <> 7"), wrong).collect()}
    assert len(told) == 49
    for (k, _), (n, crc) in right.items():
        if k != 7:
            assert told[k][0] == n - 1 and told[k][1] != crc
