from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from folioguard.llm import pieces
from folioguard.llm.queries import QUERIES

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
TEXTS = ["", " ", "   ", "▁", "▁▁a", "<s>", "<0x41>", "\n\n", " \n ", "x" * 5000, "the" * 3000, " " * 999, "é日本" * 400,
         "\x00a", " lead", "trail ", "a\tb\r\nc", "🙂🙂 ﬁ İ"]
_table = pieces.PieceTable(PATH)


def same_as_library(model, texts):
    for text, ids in zip(texts, model.encode(texts)):
        expected = LIBRARY.encode(text)
        assert ids.tolist() == expected
        assert model.decode(model.framed(ids)) == LIBRARY.decode([1, *expected, 2])


def test_odd_texts_as_the_library():
    same_as_library(_table, TEXTS)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab the▁  \n\t<s>0x41_éß日🙂\x00", max_size=150), max_size=8))
def test_any_texts_as_the_library(texts):
    same_as_library(_table, texts)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 2), st.integers(3, 258), st.integers(259, 31999)), max_size=10))
def test_decoding_any_ids(ids):
    assert _table.decode(np.array(ids, dtype="<u4")) == LIBRARY.decode(ids)


def test_a_full_table_starts_anew():
    small = pieces.PieceTable(PATH, cached_chars=40)
    for text in ["one two three four five", "six seven " * 30, "one six"]:
        same_as_library(small, [text])


def test_long_texts_go_in_stretches(monkeypatch):
    monkeypatch.setattr(pieces, "STRETCH", 7)
    monkeypatch.setattr(pieces, "BATCH_BYTES", 50)
    same_as_library(_table, ["some longer text  with two blanks\nand lines " * 9, "unbroken" * 20, " x  y "])


def test_other_models_are_refused(monkeypatch):
    monkeypatch.setattr(pieces, "PROBE", "")
    monkeypatch.setattr(pieces.PieceTable, "encode", lambda self, texts: iter([np.array([5])]))
    with pytest.raises(ValueError):
        pieces.PieceTable(PATH)


def test_odd_rows_encode_and_decode(spark, odd_docs, no_docs):
    coded = pieces.encode_documents(odd_docs, PATH)
    rows = coded.collect()
    texts = sorted((r["text"] or "") for r in odd_docs.collect())
    assert sorted(LIBRARY.decode(np.frombuffer(r["ids"], dtype="<u4").tolist()) for r in rows) == sorted(
        LIBRARY.decode(LIBRARY.encode(t)) for t in texts)
    assert sorted(r["text"] for r in pieces.decode_documents(coded, PATH).collect()) == sorted(
        LIBRARY.decode(LIBRARY.encode(t)) for t in texts)
    assert pieces.round_trip(odd_docs, PATH).count() == odd_docs.count()
    assert pieces.round_trip(no_docs, PATH).count() == 0


def test_query_as_the_library(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op12_piece_round_trip"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = [1, *LIBRARY.encode(texts[r["doc_id"]]), 2]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()
