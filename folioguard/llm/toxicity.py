"""Toxicity by multiple-instance learning: sentences are judged, documents are labelled.

A sentence's probability is logistic in hashed features of its words: each word and its character n-grams, so that a
stem learned from one word tells on others. A document is toxic if any sentence is: the sentence probabilities p are
combined by noisy-or, 1 - prod(1 - p), and the loss of the document's label is followed back through it to every
sentence. So sentences get scores although only documents have labels, and the offending ones can be pointed out.

Training is numpy on a bounded, documented sample of labelled documents, drawn by a hash of the id. Only features that
toxic documents have clearly more often get a weight. Scoring reads whole texts; a sentence's logit is a sum over its words, whose parts are
kept in a bounded cache.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioguard.llm.common import fold, held, per_text

SAMPLE_DOCS = 6_000
SAMPLE_CHARS = 20_000_000
BUCKETS = 1 << 18
GRAMS = (3, 4, 5)
LONGEST = 30
EPOCHS = 40
BATCH = 64
RATE = 0.5
DECAY = 1e-4
LEAST_EVIDENCE = 9.0  # log-likelihood ratio, and ...
LEAST_RATIO = 2.0  # ... ratio of document rates, that a feature must reach in the sample to get a weight
START_BIAS = -5.0
THRESHOLD = 0.3
CACHED_WORDS = 500_000
OFFENDING = 0.5

# Letters (A-Z lower-cased), digits, @, $ and bytes above ASCII make words; . ! ? and line ends close a sentence.
TO_SENTENCES = bytes(
    b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() or b in b"@$" else 10 if b in b".!?\n\r" else 32
    for b in range(256))


def sentences(text: str) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Words of a text, their number by sentence, and the byte each sentence starts at; sentences have words."""
    words: list[bytes] = []
    counts, starts, at = [], [], 0
    for part in text.encode("utf-8").translate(TO_SENTENCES).split(b"\n"):
        own = part.split()
        if own:
            if len(max(own, key=len)) > LONGEST:
                own = [w[i : i + LONGEST] for w in own for i in range(0, len(w), LONGEST)]
            words += own
            counts.append(len(own))
            starts.append(at)
        at += len(part) + 1
    return words, np.array(counts, dtype=np.int64), np.array(starts, dtype=np.int64)


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of words, one word's after another's, and how many each has: the word, then its n-grams."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    width = int(lengths.max(initial=2))
    table = np.zeros((len(words), width), dtype=np.uint64)
    table[np.arange(width) < lengths[:, None]] = np.frombuffer(
        b"".join([b"\x02" + w + b"\x03" for w in words]), dtype=np.uint8)
    ids = [_bucket(_mix(table, np.arange(width)), 0)[:, None]]
    live = [np.ones((len(words), 1), dtype=bool)]
    for n in GRAMS:
        if width >= n:
            grams = sum(table[:, i : width - n + 1 + i] << np.uint64(8 * i) for i in range(n))
            ids.append(_bucket(grams, n))
            live.append(np.arange(width - n + 1) + n <= lengths[:, None])
    mask = np.concatenate(live, axis=1)
    return np.concatenate(ids, axis=1)[mask], mask.sum(axis=1)


def all_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``features`` of many words, in small integers and a bounded number at a time."""
    parts = [features(words[i : i + 20_000]) for i in range(0, len(words), 20_000)]
    return (np.concatenate([p[0].astype(np.int32) for p in parts]), np.concatenate([p[1] for p in parts]))


def _mix(table: np.ndarray, columns: np.ndarray) -> np.ndarray:
    rng = np.random.default_rng(3)
    weights = rng.integers(1, 1 << 62, 4 * LONGEST, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return ((table + np.uint64(1)) * weights[columns] * (table > 0)).sum(axis=1, dtype=np.uint64)


def _bucket(key: np.ndarray, salt: int) -> np.ndarray:
    key = (key + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    key = (key ^ (key >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return (key >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def word_scores(weights: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A word's own weight and the mean of its n-grams'."""
    first = np.cumsum(counts) - counts
    values = weights[ids]
    own = values[first]
    grams = np.add.reduceat(values, first) - own if len(first) else own
    return own + grams / np.maximum(counts - 1, 1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.exp(-np.logaddexp(0, -x))


@dataclass
class Judge:
    weights: np.ndarray
    bias: float


def _telling(docs: list, labels: np.ndarray, ids: np.ndarray, sizes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which features documents of label 1 have clearly more often; chance finds in rare words would be learned else."""
    met = np.zeros((2, BUCKETS))
    for (words, _), label in zip(docs, labels):
        unique = np.unique(words)
        n = sizes[unique]
        met[int(label == 1), np.unique(ids[np.repeat(first[unique] - (np.cumsum(n) - n), n) + np.arange(n.sum())])] += 1
    total = np.array([(labels != 1).sum(), (labels == 1).sum()], dtype=float)[:, None]
    rate, pooled = met / np.maximum(total, 1), met.sum(axis=0) / max(1, len(docs))

    def fitted(p: np.ndarray) -> np.ndarray:
        p = np.clip(p, 1e-12, 1 - 1e-12)
        return (met * np.log(p) + (total - met) * np.log(1 - p)).sum(axis=0)

    evidence = 2 * (fitted(rate) - fitted(np.broadcast_to(pooled, met.shape)))
    return (evidence >= LEAST_EVIDENCE) & (rate[1] >= LEAST_RATIO * rate[0])


def fit(bags: Iterable[tuple[list[bytes], np.ndarray, int]], seed: int = 9) -> Judge:
    """Adagrad on the documents' log loss through the noisy-or; a bag has words, their number by sentence, and its
    label. Without bags every sentence keeps the starting probability."""
    rng = np.random.default_rng(seed)
    place: dict[bytes, int] = {}
    docs, marks = [], []
    for words, counts, label in bags:
        docs.append((np.array([place.setdefault(w, len(place)) for w in words], dtype=np.int32), counts))
        marks.append(label)
    if not docs:
        return Judge(np.zeros(BUCKETS, dtype=np.float32), START_BIAS)
    labels = np.array(marks)
    ids, sizes = all_features(list(place))
    first = np.cumsum(sizes) - sizes
    kept = _telling(docs, labels, ids, sizes, first)[ids]
    n_kept = np.add.reduceat(kept, first, dtype=np.int64)
    where = np.flatnonzero(kept)
    word = np.searchsorted(first, where, side="right") - 1
    part = np.where(first[word] == where, 1.0, 1 / np.maximum(sizes[word] - 1, 1))  # of an n-gram in its word's score
    ids, start = ids[where], np.cumsum(n_kept) - n_kept
    sparse = []  # of each document: features, parts, sentences (counted among those with features), other sentences
    for words, counts in docs:
        n = n_kept[words]
        index = np.repeat(start[words] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        told, sentence = np.unique(np.repeat(np.repeat(np.arange(len(counts)), counts), n), return_inverse=True)
        sparse.append((ids[index], part[index], sentence, len(told), len(counts) - len(told)))

    weights, squares = np.zeros(BUCKETS), np.full(BUCKETS, 1e-4)
    bias, bias_square = START_BIAS, 1e-2
    for _ in range(EPOCHS):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), BATCH):
            some = [sparse[i] for i in order[at : at + BATCH]]
            told = np.array([d[3] for d in some])
            plain = np.array([d[4] for d in some])
            index, share = np.concatenate([d[0] for d in some]), np.concatenate([d[1] for d in some])
            sentence = np.concatenate([d[2] + k for d, k in zip(some, np.cumsum(told) - told)])
            of_doc = np.repeat(np.arange(len(some)), told)
            logits = np.bincount(sentence, weights=weights[index] * share, minlength=told.sum()) + bias
            clean = -np.bincount(of_doc, weights=np.logaddexp(0, logits), minlength=len(some)) - plain * np.logaddexp(0, bias)
            # the slope of the loss: 1 for clean documents, -(1 - P) / P for toxic ones, times each sentence's p
            toxic = labels[order[at : at + BATCH]] == 1
            slope = np.where(toxic, -np.exp(clean) / np.maximum(-np.expm1(clean), 1e-9), 1.0) / len(some)
            d_logit = slope[of_doc] * sigmoid(logits)
            grad = np.bincount(index, weights=d_logit[sentence] * share, minlength=BUCKETS)
            squares += grad**2
            weights -= RATE * (grad / np.sqrt(squares) + DECAY * weights)
            d_bias = d_logit.sum() + (slope * plain).sum() * sigmoid(np.float64(bias))
            bias_square += d_bias**2
            bias -= RATE * d_bias / np.sqrt(bias_square)
    return Judge(weights.astype(np.float32), float(bias))


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Judge:
    """A judge from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic). Rows without a label teach nothing.

    The driver gets at most ``sample_docs`` labelled documents, those with the smallest hash of their id, and of these,
    in that order, as many as have ``SAMPLE_CHARS`` characters together.
    """
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    draw = F.xxhash64(F.col("doc_id").cast("string")).alias("draw")
    label = {r["doc_id"]: r["toxic"] for r in marks.select("*", draw).orderBy("draw").limit(sample_docs).collect()}
    if not label:
        return fit([])
    kind = docs.schema["doc_id"].dataType.simpleString()
    chosen = docs.sparkSession.createDataFrame([(d,) for d in label], f"of_id {kind}")
    rows = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("of_id")).select("doc_id", "text", draw)

    def bags() -> Iterator[tuple[list[bytes], np.ndarray, int]]:
        room = SAMPLE_CHARS
        for doc_id, text, _ in rows.orderBy("draw", "doc_id").limit(2 * sample_docs).toLocalIterator():
            room -= len(text or "")
            if room < 0:
                return
            words, counts, _ = sentences(text or "")
            if words:
                yield words, counts, label[doc_id]

    return fit(bags())


class WordScores(dict):
    """Scores of the words met, by place in one array; bounded by ``CACHED_WORDS``."""

    def __init__(self, judge: Judge):
        super().__init__()
        self.judge = judge
        self.scores = np.zeros(0, dtype=np.float64)

    def learn(self, wanted: set[bytes]) -> None:
        new = list(wanted - self.keys())
        if len(self) + len(new) > CACHED_WORDS:
            self.clear()
            self.scores = self.scores[:0]
            new = list(wanted)
        parts = [word_scores(self.judge.weights, *features(new[i : i + 20_000])) for i in range(0, len(new), 20_000)]
        self.update(zip(new, range(len(self), len(self) + len(new))))
        self.scores = np.concatenate([self.scores, *parts])

    def judge_texts(self, texts: list[str]) -> dict[str, list]:
        cut = [sentences(t) for t in texts]
        self.learn({w for words, _, _ in cut for w in words})
        get = self.__getitem__
        out: dict[str, list] = {c: [] for c in ("score", "n_sentences", "n_offending", "worst_start", "worst_score")}
        for words, counts, starts in cut:
            if not words:
                for c, v in zip(out, (0.0, 0, 0, None, 0.0)):
                    out[c].append(v)
                continue
            places = np.fromiter(map(get, words), dtype=np.int64, count=len(words))
            logits = np.add.reduceat(self.scores[places], np.cumsum(counts) - counts) + self.judge.bias
            p = sigmoid(logits)
            worst = int(logits.argmax())
            out["score"].append(float(-np.expm1(-np.logaddexp(0, logits).sum())))
            out["n_sentences"].append(len(counts))
            out["n_offending"].append(int((p >= OFFENDING).sum()))
            out["worst_start"].append(int(starts[worst]))
            out["worst_score"].append(float(p[worst]))
        return out


def score(docs: DataFrame, judge: Judge, name: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, score, n_sentences, n_offending (probability of a half or more), worst_start (the byte at which the
    likeliest sentence starts) and worst_score for every document; ``name`` tells judges apart on the workers.

    Null texts and texts without a word have score 0 and no worst sentence. Repeats and null ids are kept.
    """

    weights, bias = docs.sparkSession.sparkContext.broadcast(judge.weights.tobytes()), judge.bias  # 1 MB

    def prepare():
        return held(f"toxicity {name}", lambda: WordScores(
            Judge(np.frombuffer(weights.value, dtype=np.float32), bias))).judge_texts

    return per_text(docs, keep, prepare, "score double, n_sentences bigint, n_offending bigint, worst_start bigint, "
                    "worst_score double", rows=256)


def locate(text: str, judge: Judge, least: float = OFFENDING) -> list[tuple[int, int, float]]:
    """Start and end byte and probability of the sentences of one text that reach ``least``."""
    words, counts, starts = sentences(text)
    if not words:
        return []
    logits = np.add.reduceat(word_scores(judge.weights, *features(words)), np.cumsum(counts) - counts) + judge.bias
    raw = text.encode("utf-8").translate(TO_SENTENCES)
    ends = [e if (e := raw.find(b"\n", s)) >= 0 else len(raw) for s in starts.tolist()]
    p = sigmoid(logits)
    return [(s, e, float(q)) for s, e, q in zip(starts.tolist(), ends, p) if q >= least]


def judge_documents(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    """Train outside the held-out fold, score every document: doc_id, held_out, score, predicted and the sentences'
    columns of ``score``."""
    learned = fold(F.col("doc_id"), folds) != held_out
    judge = train(docs.select("doc_id", "text").where(learned), labels.select("doc_id", "toxic").where(learned))
    scored = score(docs, judge, uuid.uuid4().hex)
    return scored.select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_sentences", "n_offending", "worst_start",
        "worst_score")
