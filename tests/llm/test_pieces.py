"""Piece ids against the SentencePiece library; exact round trips."""

from __future__ import annotations

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from loometry.llm.arrays import text_slices
from loometry.llm.pieces import decode, encode, loaded, marked
from loometry.llm.queries import QUERIES, table

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_query_matches_the_library(spark, data_dir, library):
    texts = {r.doc_id: r.text for r in table(spark, data_dir, "documents").collect()}
    rows = QUERIES["op4_pieces"](spark, data_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.ids == library.encode(texts[r.doc_id] or "") and r.n_ids == len(r.ids) and r.round_trip


TEXTS = ["", None, " ", "  ", "a", " a", "a  b   c ", "\n\n x\t", "日本語 𝔘", "x" * 2000, "the" * 300, "<s> </s> <unk> <0x41>", "ab ab", "a b", "🙂🙂"]


def test_edge_texts(spark, library):
    rows = [(i, t, "r") for i, t in enumerate(TEXTS)] * 2 + [(None, "no id", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    both = decode(encode(docs, MODEL), MODEL)
    assert both.columns == ["doc_id", "text", "row", "_ids", "_same", "_decoded"]
    found = both.collect()
    assert len(found) == len(rows)
    for r in found:
        assert r._ids == library.encode(r.text or "") and r._decoded == (r.text or "") and r._same
    assert encode(docs.limit(0), MODEL).count() == 0


def test_a_literal_mark_reads_as_a_space(spark, library):
    docs = spark.createDataFrame([("a▁b ▁c▁",)], "text string")
    r = decode(encode(docs, MODEL), MODEL).first()
    assert r._ids == library.encode("a▁b ▁c▁") and r._decoded == "a b  c " and not r._same


def test_ids_that_are_no_text(spark):
    docs = spark.createDataFrame([([3 + 255, 1, 2],), (None,), ([],)], "_ids array<int>")
    assert [r._decoded for r in decode(docs, MODEL).collect()] == ["�", "", ""]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aehinorst  \n.éü日𝔘"), max_size=40))
def test_random_texts(text):
    import pyarrow as pa

    pieces = loaded(MODEL)
    ids = [i for _, _, raw, borders in text_slices(pa.array([text])) for i in pieces.encode(*marked(raw, borders))[0].tolist()]
    assert ids == pieces.processor.encode(text)
