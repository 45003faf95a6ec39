from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from folioguard.llm import common, token_files
from tests.llm.test_bpe import LETTERS

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("bits, most", [(1, 1 << 16), (2, 70_000), (2, 1 << 32)])
@pytest.mark.parametrize("n", [0, 1, 3, 4, 7, 8, 9, 1_000])
def test_packing_round_trip(bits, most, n):
    ranks = np.random.default_rng(n).integers(0, most, n, dtype=np.uint64).astype(np.uint32)
    ranks[: n // 2] %= 300
    control, data = token_files.pack(ranks, bits)
    assert len(control) == -(-n * bits // 8)
    assert (token_files.unpack(control, data, n, bits) == ranks).all()


def test_words_together_give_the_librarys_ids(monkeypatch):
    library = Tokenizer.from_file(PATH)
    rnd = random.Random(2)
    texts = ["".join(rnd.choice(LETTERS + "é̈ ΣΑ") for _ in range(rnd.randint(0, 40))) for _ in range(3_000)]
    texts += ["<|endoftext|> a<|startoftext|>b", "", "it's THEY'RE we'll ''s", "a b c"]
    expected = [[*library.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert [i.tolist() for i in token_files.encode_texts(PATH, texts, 2)] == expected
    monkeypatch.setattr(token_files, "CACHED_WORDS", 50)
    monkeypatch.setattr(token_files, "CACHED_PIECES", 20)
    monkeypatch.setattr(token_files, "BATCH_CHARS", 2_000)
    common.release()
    assert [i.tolist() for i in token_files.encode_texts(PATH, texts, 2)] == expected
    common.release()


def expected_rows(rows):
    library = Tokenizer.from_file(PATH)
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def test_files_hold_all_documents_in_order(spark, tmp_path, monkeypatch, no_docs):
    monkeypatch.setattr(token_files, "FILE_IDS", 500)
    monkeypatch.setattr(token_files, "BLOCK_IDS", 100)
    rnd = random.Random(4)
    rows = [(i * 3 - 50, " ".join(rnd.choice(["alpha", "beta", "gamma", "δ"]) for _ in range(rnd.randint(0, 30))))
            for i in rnd.sample(range(200), 200)] + [(None, "no id"), (2**60, None), (2**60 + 1, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [tuple(r) for r in token_files.file_round_trip(docs, PATH, f"{tmp_path}/files").collect()]
    assert sorted(got, key=lambda r: r[1]) == expected_rows(rows)
    assert token_files.file_round_trip(no_docs, PATH, f"{tmp_path}/none").count() == 0


def test_odd_rows(odd_docs, tmp_path):
    got = token_files.file_round_trip(odd_docs, PATH, f"{tmp_path}/odd").collect()
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    expected = expected_rows(rows)
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(d) for d, *_ in expected)
    assert sorted(r["ids_crc32"] for r in got) == sorted(e[3] for e in expected)
    ordered = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in ordered] == list(np.cumsum([0, *[r["n_tokens"] for r in ordered[:-1]]]))
