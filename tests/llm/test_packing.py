"""Packing against whole-text encoding and its limits."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loometry.llm.packing import encode, pack, pack_texts
from loometry.llm.queries import QUERIES, table

FILE = public_tokenizers.path("word_bpe_49k.json")


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def check(pieces, whole, tokens=2048):
    """Pieces tile their documents; sequences are gapless and need no padding."""
    by_key, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_key[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert set(by_key) == set(whole)
    for key, ids in whole.items():
        at = 0
        for p in sorted(by_key[key], key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids))
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for rows in by_sequence.values():
        at = 0
        for p in sorted(rows, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at == tokens or (at < tokens and at & (at - 1) == 0)
    return by_sequence


def test_query_packs_every_id_without_padding(spark, data_dir):
    tokenizer = Tokenizer.from_file(FILE)
    whole = {r.doc_id: ids_of(tokenizer, r.text) for r in table(spark, data_dir, "documents").collect()}
    check(QUERIES["op12_packing"](spark, data_dir).collect(), whole)


TEXTS = [
    "", None, " ", "a", "It's WE'LL 's 'S", "12 345 6th", "é ö 日本 語 É ́x", "<|endoftext|> x<|endoftext|>y <|startoftext|>", "tab\tand\r\nline\x0b\x0cx",
    "a b　c d", "ΣΑΣ ΑΣ", "🙂 🙂🙂", "word " * 9000, "x" * 30000, " lead", "trail \n", "A,b.c;D:É!ñ?× ,×,÷. 1.5,a.. İ, ǅ. \u0345a, X<|ENDOFTEXT|>. <|endoftext|>,",
    "A" + "\u0301. e\u0301,e\u0301 가나, \u1112\u1161\u11ab. ﬁ, ŉ. it's, IT'S. 's. 'LL,",
]


def test_odd_texts(spark):
    tokenizer = Tokenizer.from_file(FILE)
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(TEXTS)], "doc_id long, text string, key string")
    for packed in (pack(encode(docs.repartition(1), FILE)), pack_texts(docs.repartition(3), FILE)):
        packed = packed.select(
            F.col("key").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), F.col("n_ids").alias("doc_tokens"), "sequence_id", "offset"
        )
        check(packed.collect(), {i: ids_of(tokenizer, t) for i, t in enumerate(TEXTS)})


def test_null_and_repeated_keys_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, None), (7, "a b"), (7, "a b"), (7, "c")], "doc_id long, text string")
    got = pack(encode(docs, FILE)).groupBy("key").agg(F.sum("length").alias("n")).collect()
    assert {r.key: r.n for r in got} == {None: 4, 7: 8}
    assert pack(encode(docs.filter("false"), FILE)).count() == 0


def examples(spark, seed, n=3000):
    rng = np.random.default_rng(seed)
    sizes, shares = rng.integers(1, 400, n), rng.random(n)
    rows = [(i, np.arange(s, dtype="<u4").tobytes(), int(s * h)) for i, (s, h) in enumerate(zip(sizes.tolist(), shares.tolist(), strict=True))]
    return spark.createDataFrame(rows, "key long, ids binary, prompt long").coalesce(1), rows


def test_three_limits_hold_and_whole_examples_stay_whole(spark):
    df, rows = examples(spark, 1)
    prompt = {k: p for k, _, p in rows}
    got = pack(df, tokens=512, segments=6, loss_tokens=200, prompt="prompt", cut=False).collect()
    loss = {}
    sequences = defaultdict(list)
    for p in got:
        loss[p.key, p.start] = max(0, p.start + p.length - max(p.start, prompt[p.key]))
        sequences[p.sequence_id].append(p)
    assert sum(p.length for p in got) == sum(len(i) // 4 for _, i, _ in rows)
    for members in sequences.values():
        assert sum(p.length for p in members) <= 512 and len(members) <= 6
        assert sum(loss[p.key, p.start] for p in members) <= 200
    for key, ids, p in rows:
        pieces = [q for q in got if q.key == key]
        alone = len(ids) // 4 <= 512 and len(ids) // 4 - p <= 200
        assert not alone or len(pieces) == 1
        if len(pieces) > 1:
            break
    # The tightest limit tells how few sequences there could be.
    least = max(sum(p.length for p in got) / 512, len(got) / 6, sum(loss.values()) / 200)
    assert len(sequences) <= 1.1 * least + 2


def test_dot_product_mixes_demands(spark):
    """Examples with much loss share sequences with those that have none."""
    rows = [(i, np.arange(100, dtype="<u4").tobytes(), 0 if i % 2 else 100) for i in range(400)]
    df = spark.createDataFrame(rows, "key long, ids binary, prompt long").coalesce(1)
    got = pack(df, tokens=1000, segments=20, loss_tokens=500, prompt="prompt", cut=False).collect()
    assert len({p.sequence_id for p in got}) == 40


def test_few_segments_end_at_powers_of_two(spark):
    rows = [(i, np.arange(7, dtype="<u4").tobytes()) for i in range(50)]
    df = spark.createDataFrame(rows, "key long, ids binary").coalesce(1)
    got = pack(df, tokens=64, segments=3)
    sizes = [r.n for r in got.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()]
    assert sum(sizes) == 350 and all(n & (n - 1) == 0 for n in sizes)
    assert max(r["count"] for r in got.groupBy("sequence_id").count().collect()) <= 3
