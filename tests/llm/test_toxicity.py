from __future__ import annotations

import random

import numpy as np
import pytest

from folioguard.llm import toxicity


def invented(n, seed):
    """Documents of clean sentences; of those with label 1 some sentences hold a word with the stem ``grub``."""
    rnd = random.Random(seed)
    parts = ["ka", "lo", "mi", "ten", "sur", "va", "pel", "dor"]
    endings = ["ish", "ing", "er", "ed", "ous", "al", "ity", "ment"]

    def word():
        return "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 3)))

    out = []
    for i in range(n):
        label = int(rnd.random() < 0.3)
        lines = [" ".join(word() for _ in range(rnd.randint(3, 9))) for _ in range(rnd.randint(2, 12))]
        if label:
            for at in rnd.sample(range(len(lines)), rnd.randint(1, 2)):
                lines[at] += f" grub{rnd.choice(endings)}{rnd.choice(endings)} {word()}"
        out.append((i, ". ".join(lines) + ".", label))
    return out


@pytest.fixture(scope="module")
def judge():
    bags = [(*toxicity.sentences(t)[:2], y) for _, t, y in invented(400, 1)]
    return toxicity.fit(bags)


def test_labels_of_documents_teach_sentences(judge):
    rows = invented(200, 2)
    scores = np.array(toxicity.WordScores(judge).judge_texts([t for _, t, _ in rows])["score"])
    labels = np.array([y for *_, y in rows])
    assert ((scores >= 0.3) == (labels == 1)).mean() > 0.97
    hits = 0
    for _, text, label in rows:
        found = [text.encode()[a:b].decode() for a, b, _ in toxicity.locate(text, judge)]
        assert all("grub" in s for s in found) and (label or not found)
        hits += bool(found)
    assert hits > 0.8 * labels.sum()


def test_noisy_or_of_sentences(judge):
    text = "ka lo mi. grubisher ka lo. sur va pel! grubment"
    words, counts, starts = toxicity.sentences(text)
    logits = np.add.reduceat(toxicity.word_scores(judge.weights, *toxicity.features(words)), np.cumsum(counts) - counts)
    p = 1 / (1 + np.exp(-(logits + judge.bias)))
    made = toxicity.WordScores(judge).judge_texts([text])
    assert made["score"][0] == pytest.approx(1 - np.prod(1 - p))
    assert made["n_sentences"] == [4] and made["n_offending"] == [int((p >= 0.5).sum())]
    assert text.encode()[made["worst_start"][0] :].lstrip()[:4] == b"grub"
    assert starts.tolist() == [0, 9, 26, 38]


def test_features_do_not_depend_on_neighbours():
    words = [b"a", b"longer", "größe".encode(), b"x" * 30]
    ids, sizes = toxicity.features(words)
    alone = [toxicity.features([w]) for w in words]
    assert np.concatenate([a[0] for a in alone]).tolist() == ids.tolist()
    assert [int(a[1][0]) for a in alone] == sizes.tolist()
    many = toxicity.all_features(words * 9_000)
    assert many[0][: len(ids)].tolist() == ids.tolist() and len(many[1]) == 36_000


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (5, 0), (7, 0), (7, 1), (None, 1), (9, None), (99, 1)], "doc_id long, toxic int")
    got = toxicity.judge_documents(odd_docs, labels).collect()
    assert len(got) == odd_docs.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert {r["doc_id"] for r in got if r["n_sentences"] == 0} == {None, 2, 3, 4}
    assert all(r["score"] == 0 and r["worst_start"] is None for r in got if r["n_sentences"] == 0)
    assert toxicity.judge_documents(no_docs, labels).count() == 0
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["predicted"] for r in toxicity.judge_documents(odd_docs.limit(3), none).collect()} == {0}


def test_held_out_rows_are_told_apart(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = toxicity.judge_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert got.where("held_out != (crc32(cast(cast(doc_id as string) as binary)) % 4 = 2)").count() == 0
    assert got.count() == docs.count()
