from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from folioguard.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
LETTERS = "abcdeéèßñ 12.,'\n\t  \x1c\x1d\x85\xa0 　日本語🙂ΣİÁ\x00'sthe|<>endoftext"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts(n):
    rnd = random.Random(1)
    out = ["".join(rnd.choice(LETTERS) for _ in range(rnd.randint(0, 40))) for _ in range(n)]
    out += [f"{t}<|endoftext|>{t}" for t in out[:100]]
    return [*out, "", " ", "  a", " a ", "a" * 5_000, "\x01\x02" * 300, " " * 3_000 + "x", "internationalization " * 50]


def test_ids_and_texts_equal_the_library(library):
    coder = bpe.vocabulary(PATH)
    sample = texts(3_000)
    for text, raw in zip(sample, coder.encode(sample)):
        ids = np.frombuffer(raw, dtype="<u4")
        expected = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == expected, repr(text)
        assert coder.decode(ids).decode("utf-8", "replace") == library.decode(expected, skip_special_tokens=False)


def test_small_caches_change_nothing(monkeypatch):
    sample = texts(300)
    expected = list(bpe.vocabulary(PATH).encode(sample))
    monkeypatch.setattr(bpe, "CACHED_WORDS", 5)
    monkeypatch.setattr(bpe, "CACHED_PIECES", 5)
    monkeypatch.setattr(bpe, "BATCH_CHARS", 200)
    assert list(bpe.ByteBPE(PATH).encode(sample)) == expected


def test_pairs_are_those_that_merging_by_rank_leaves():
    coder = bpe.vocabulary(PATH)
    entries = [coder.pool[coder.places[i] : coder.places[i] + coder.lengths[i]].tobytes() for i in coder.ids]
    number = {e: i for i, e in enumerate(entries)}
    rng = np.random.default_rng(3)
    left, right = rng.integers(0, 3_000, 300), rng.integers(0, 3_000, 300)
    for a, b, fit in zip(left.tolist(), right.tolist(), coder.compatible(left, right).tolist()):
        parts = [bytes([x]) for x in entries[a] + entries[b]]
        while len(parts) > 1:
            pairs = np.array([number[x] << 32 | number[y] for x, y in zip(parts, parts[1:])])
            ranks = np.where((found := coder.merged.get(pairs)) >= 0, found, coder.n)
            if ranks.min() == coder.n:
                break
            at = int(ranks.argmin())
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        assert (parts == [entries[a], entries[b]]) == fit


def test_round_trip_query_on_odd_rows(odd_docs, no_docs, library):
    rows = bpe.round_trip(odd_docs, PATH).collect()
    assert len(rows) == odd_docs.count()
    expected = []
    for r in odd_docs.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        expected.append((str(r["doc_id"]), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                         hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert sorted((str(r[0]), *r[1:]) for r in rows) == sorted(expected)
    assert bpe.round_trip(no_docs, PATH).count() == 0


def test_encode_and_decode_documents(odd_docs):
    coded = bpe.encode_documents(odd_docs, PATH)
    back = {(str(r["doc_id"]), r["text"]) for r in bpe.decode_documents(coded, PATH).collect()}
    assert back == {(str(r["doc_id"]), r["text"] or "") for r in odd_docs.collect()}
