"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the bytes of a word (a run of letters and of bytes above ASCII, A-Z lower-cased) in both directions
and labels every position with a probability for each language. A word's positions are pooled by their mean logarithm,
a document's words by their sum, so each position of the whole text counts. Words repeat far more often than texts, so
a worker keeps the pooled vectors of the words it met in a bounded cache and runs the network on new words only, many
at a time.

Training is plain numpy: truncated at word ends, backpropagation through time with Adam, on a bounded and documented
sample of labelled documents, drawn by a hash of the id. Words are drawn evenly over the languages, so common
languages get no head start.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioguard.llm.common import fold, held, per_text

UNKNOWN = "und"
SAMPLE_DOCS = 3_000
SAMPLE_WORDS = 24_000  # of each language
HIDDEN = 16
EMBEDDED = 12
LONGEST = 32  # bytes read as one sequence; longer runs are cut
EPOCHS = 4
BATCH = 256
RATE = 0.01
CACHED_WORDS = 400_000
NETWORK_WORDS = 50_000

LETTER = regex.compile(r"\p{L}")
# ASCII letters, lower-cased, and all bytes above ASCII stay; the rest separates words.
TO_WORDS = bytes(
    b if b > 127 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    words = text.encode("utf-8").translate(TO_WORDS).split()
    if any(len(w) > LONGEST for w in words):
        words = [w[i : i + LONGEST] for w in words for i in range(0, len(w), LONGEST)]
    return words


def sequences(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words as rows of bytes, filled up with zeros, and their lengths."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    table = np.zeros((len(words), int(lengths.max(initial=1))), dtype=np.uint8)
    table[np.arange(table.shape[1]) < lengths[:, None]] = np.frombuffer(b"".join(words), dtype=np.uint8)
    return table, lengths


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Network:
    """Weights of both directions (0 forward, 1 backward) and the languages they tell apart."""

    languages: list[str]
    weights: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, languages: list[str], seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        weights = {"embed": rng.normal(0, 0.3, (256, EMBEDDED))}
        for d in (0, 1):
            weights[f"in{d}"] = rng.normal(0, EMBEDDED**-0.5, (EMBEDDED, 3 * HIDDEN))
            weights[f"bias{d}"] = np.zeros(3 * HIDDEN)
            weights[f"back{d}"] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, 3 * HIDDEN))
            weights[f"inner{d}"] = np.zeros(HIDDEN)
            weights[f"out{d}"] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, len(languages)))
        weights["last"] = np.zeros(len(languages))
        return cls(languages, {k: v.astype(np.float32) for k, v in weights.items()})

    def _direction(self, d: int, table: np.ndarray, live: np.ndarray, keep: list | None) -> np.ndarray:
        """States after each position; ``live`` marks positions inside a word, elsewhere the state stands still.

        Columns of gates: update, reset, candidate.
        """
        w, h3 = self.weights, HIDDEN
        gates = w["embed"] @ w[f"in{d}"] + w[f"bias{d}"]
        back, inner = w[f"back{d}"], w[f"inner{d}"]
        n, steps = table.shape
        state = np.zeros((n, h3), dtype=np.float32)
        states = np.zeros((steps, n, h3), dtype=np.float32)
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            x, u = gates[table[:, t]], state @ back
            both = sigmoid(x[:, : 2 * h3] + u[:, : 2 * h3])
            update, reset = both[:, :h3], both[:, h3:]
            recalled = u[:, 2 * h3 :] + inner
            candidate = np.tanh(x[:, 2 * h3 :] + reset * recalled)
            on = live[:, t, None]
            if keep is not None:
                keep.append((t, state, update, reset, recalled, candidate))
            state = np.where(on, candidate + update * (state - candidate), state)
            states[t] = state
        return states

    def positions(self, table: np.ndarray, lengths: np.ndarray, keep: tuple[list, list] | None = None):
        """Log probabilities of the languages at every position (steps, words, languages)."""
        live = np.arange(table.shape[1]) < lengths[:, None]
        w = self.weights
        states = [self._direction(d, table, live, keep[d] if keep else None) for d in (0, 1)]
        scores = states[0] @ w["out0"] + states[1] @ w["out1"] + w["last"]
        scores -= scores.max(axis=2, keepdims=True)
        scores -= np.log(np.exp(scores).sum(axis=2, keepdims=True))
        return scores, states, live

    def word_vectors(self, words: list[bytes]) -> np.ndarray:
        """Mean log probabilities over the positions of each word."""
        out = np.zeros((len(words), len(self.languages)), dtype=np.float32)
        order = np.array(sorted(range(len(words)), key=lambda i: len(words[i])), dtype=np.int64)
        for start in range(0, len(order), 4096):
            some = order[start : start + 4096]
            table, lengths = sequences([words[i] for i in some])
            scores, _, live = self.positions(table, lengths)
            out[some] = (scores * live.T[:, :, None]).sum(axis=0) / lengths[:, None]
        return out

    def gradients(self, table: np.ndarray, lengths: np.ndarray, target: np.ndarray) -> tuple[float, dict]:
        """Mean loss over all positions and its gradients, by backpropagation through time."""
        keep: tuple[list, list] = ([], [])
        scores, states, live = self.positions(table, lengths, keep)
        w, h3, total = self.weights, HIDDEN, live.sum()
        hot = np.eye(len(self.languages), dtype=np.float32)[target]
        mask = live.T[:, :, None]
        loss = -float((scores * hot * mask).sum() / total)
        d_scores = (np.exp(scores) - hot) * mask / np.float32(total)
        grads = {k: np.zeros_like(v) for k, v in w.items()}
        grads["last"] = d_scores.sum(axis=(0, 1))
        for d in (0, 1):
            grads[f"out{d}"] = np.einsum("tnh,tnl->hl", states[d], d_scores)
            through = d_scores @ w[f"out{d}"].T
            d_state = np.zeros_like(states[d][0])
            d_gates = np.zeros((256, 3 * h3), dtype=np.float32)
            for t, before, update, reset, recalled, candidate in reversed(keep[d]):
                d_state = d_state + through[t]
                on = live[:, t, None]
                moved = np.where(on, d_state, 0)
                d_candidate = moved * (1 - update) * (1 - candidate**2)
                d_update = moved * (before - candidate) * update * (1 - update)
                d_reset = d_candidate * recalled * reset * (1 - reset)
                d_recalled = d_candidate * reset
                d_x = np.concatenate([d_update, d_reset, d_candidate], axis=1)
                d_u = np.concatenate([d_update, d_reset, d_recalled], axis=1)
                grads[f"back{d}"] += before.T @ d_u
                grads[f"inner{d}"] += d_recalled.sum(axis=0)
                np.add.at(d_gates, table[:, t], d_x)
                d_state = np.where(on, moved * update + d_u @ w[f"back{d}"].T, d_state)
            grads[f"in{d}"] = w["embed"].T @ d_gates
            grads["embed"] += d_gates @ w[f"in{d}"].T
            grads[f"bias{d}"] = d_gates.sum(axis=0)
        return loss, grads

    def fit(self, words: list[bytes], target: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> Network:
        """Adam over shuffled batches of words of like length."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        lengths = np.array([len(w) for w in words])
        step, rounds = 0, epochs * -(-len(words) // BATCH)
        for _ in range(epochs):
            order = rng.permutation(len(words))
            order = order[np.argsort(lengths[order] // 3, kind="stable")]
            batches = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
            for b in rng.permutation(len(batches)):
                some = batches[b]
                table, n = sequences([words[i] for i in some])
                _, grads = self.gradients(table, n, target[some])
                step += 1
                rate = RATE * (1 - 0.9 * step / rounds)
                for k, g in grads.items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.01 * (g * g - second[k])
                    move = (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
                    self.weights[k] = (self.weights[k] - rate * move).astype(np.float32)
        return self


def train(docs: DataFrame, label: str = "lang", sample_docs: int = SAMPLE_DOCS, sample_words: int = SAMPLE_WORDS) -> Network:
    """A network for the labels of ``docs`` (doc_id, text, label); rows without label or text teach nothing.

    At most ``sample_docs`` documents are drawn, those with the smallest hash of their id, and ``sample_words`` words of
    each label, so what reaches the driver is bounded. Without labelled rows the network knows no language.
    """
    drawn = docs.select(
        F.xxhash64(F.col("doc_id").cast("string")).alias("draw"), F.col("text"), F.col(label).alias("label")
    ).where(F.col("label").isNotNull() & F.col("text").isNotNull())
    smallest = drawn.select("draw").orderBy("draw").limit(sample_docs)
    bound = smallest.agg(F.max("draw")).first()[0]
    if bound is None:
        return Network([], {})
    rows = drawn.where(F.col("draw") <= bound).orderBy("draw").limit(sample_docs).select("text", "label").toLocalIterator()
    by_label: dict[str, list[bytes]] = {}
    for text, name in rows:
        by_label.setdefault(name, []).extend(words_of(text))
    rng = np.random.default_rng(5)
    words, target, names = [], [], sorted(n for n, w in by_label.items() if w)
    for number, name in enumerate(names):
        pool = by_label[name]
        for i in rng.integers(0, len(pool), sample_words):
            words.append(pool[i])
            target.append(number)
    if not names:
        return Network([], {})
    return Network.fresh(names).fit(words, np.array(target))


class WordVectors(dict):
    """Pooled vectors of the words met, by place in one array; bounded by ``CACHED_WORDS``."""

    def __init__(self, network: Network):
        super().__init__()
        self.network = network
        self.rows = np.zeros((0, len(network.languages)), dtype=np.float32)

    def learn(self, wanted: set[bytes]) -> None:
        new = [w for w in wanted if w not in self]
        if len(self) + len(new) > CACHED_WORDS:
            self.clear()
            self.rows = self.rows[:0]
            new = list(wanted)
        if new:
            base = len(self)
            made = [self.network.word_vectors(new[i : i + NETWORK_WORDS]) for i in range(0, len(new), NETWORK_WORDS)]
            self.rows = np.concatenate([self.rows, *made])
            self.update(zip(new, range(base, base + len(new))))

    def pooled(self, texts: list[str]) -> list[tuple[str, float]]:
        """Language and probability of each text."""
        if not self.network.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        out: list[tuple[str, float]] = []
        cut = [words_of(t) for t in texts]
        self.learn({w for words in cut for w in words})
        get = self.__getitem__
        for text, words in zip(texts, cut):
            if not words or LETTER.search(text) is None:
                out.append((UNKNOWN, 0.0))
                continue
            places = np.fromiter(map(get, words), dtype=np.int64, count=len(words))
            sums = self.rows[places].sum(axis=0, dtype=np.float64)
            odds = np.exp(sums - sums.max())
            best = int(sums.argmax())
            out.append((self.network.languages[best], float(odds[best] / odds.sum())))
        return out


def predict(docs: DataFrame, network: Network, name: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, lang_pred and score for every document; ``name`` tells networks apart on the workers.

    Null texts and texts without a letter are ``und`` with score 0. Every row is kept, repeats and null ids included.
    """

    def prepare():
        vectors = held(f"language {name}", lambda: WordVectors(network))

        def work(texts: list[str]) -> dict:
            made = vectors.pooled(texts)
            return {"lang_pred": [m[0] for m in made], "score": [m[1] for m in made]}

        return work

    return per_text(docs, keep, prepare, "lang_pred string, score double", rows=256)


def identify(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), folds: int = 5, held_out: int = 0) -> DataFrame:
    """Train on the labelled documents outside the held-out fold and predict every document."""
    network = train(docs.where(fold(F.col("doc_id"), folds) != held_out))
    return predict(docs, network, uuid.uuid4().hex, keep)
