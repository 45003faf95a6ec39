from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioguard.llm import language


def test_gradients_follow_the_loss():
    network = language.Network.fresh(["a", "b", "c"])
    network.weights = {k: v.astype(np.float64) for k, v in network.weights.items()}
    table, lengths = language.sequences([b"hello", b"ab", b"xyzzy", b"q"])
    target = np.array([0, 1, 2, 0])
    _, grads = network.gradients(table, lengths, target)
    rng = np.random.default_rng(0)
    for name, w in network.weights.items():
        for _ in range(4):
            at = (ord("l"), int(rng.integers(0, w.shape[1]))) if name == "embed" else tuple(rng.integers(0, n) for n in w.shape)
            old, step = w[at], 1e-3
            w[at] = old + step
            up = network.gradients(table, lengths, target)[0]
            w[at] = old - step
            down = network.gradients(table, lengths, target)[0]
            w[at] = old
            assert (up - down) / (2 * step) == pytest.approx(grads[name][at], abs=1e-4)


def test_padding_and_neighbours_do_not_change_a_word():
    network = language.Network.fresh(["a", "b"])
    words = [b"one", b"a", b"longerword", "größer".encode()]
    together = network.word_vectors(words)
    for word, vector in zip(words, together):
        assert np.allclose(network.word_vectors([word])[0], vector, atol=1e-6)


def test_long_runs_are_cut_and_nothing_is_lost():
    text = "Ab1c" + "x" * 100 + " é"
    words = language.words_of(text)
    assert b"".join(words) == b"abc" + b"x" * 100 + "é".encode()
    assert max(map(len, words)) <= language.LONGEST


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = language.identify(docs, keep=("doc_id", "lang"), folds=5, held_out=0)
    unseen = got.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    assert unseen.count() > 20
    assert unseen.where("lang = lang_pred").count() >= 0.95 * unseen.count()
    assert got.where("score < 0 or score > 1").count() == 0


def test_odd_rows(odd_docs, no_docs):
    got = language.identify(odd_docs).collect()
    assert len(got) == odd_docs.count()
    unknown = [r for r in got if r["lang_pred"] == "und"]
    assert {r["doc_id"] for r in unknown} == {None, 2, 3, 4, 8} and all(r["score"] == 0 for r in unknown)
    assert {r["lang_pred"] for r in got} <= {"und", "en", "fr"}
    assert language.identify(no_docs).count() == 0


def test_without_labels_nothing_is_known(spark):
    docs = spark.createDataFrame([(1, "words", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language.identify(docs).collect()} == {"und"}


def test_cache_bound_changes_nothing(monkeypatch):
    network = language.Network.fresh(["a", "b"])
    texts = [f"some words here number {'x' * i} and more" for i in range(40)]
    expected = language.WordVectors(network).pooled(texts)
    monkeypatch.setattr(language, "CACHED_WORDS", 3)
    small = language.WordVectors(network)
    got = [small.pooled([t])[0] for t in texts]
    assert [g[0] for g in got] == [e[0] for e in expected]
    assert np.allclose([g[1] for g in got], [e[1] for e in expected])
