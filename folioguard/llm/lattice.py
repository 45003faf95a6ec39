"""Language-model scores by subword lattice likelihood.

The vocabulary is that of an existing tokenizer, whose scores start the piece probabilities; expectation-maximisation
over all training words re-estimates them. A word's probability sums over all ways to cut it into pieces (forward
recursion in logs), a text's is the product over its words and an end, all drawn from one distribution. Pieces do not
cross words, so the recursion runs once for each distinct word of the corpus.

How the words travel. One pass over the texts numbers the words of each block (a bounded stretch of a task's input) and
writes, for each document, the numbers of its words, and for each block its word list with training counts. The lists
are joined into one table of distinct words, which gives the counts, the training set and each word's score; scores go
back to their blocks, where they meet the documents. Word occurrences are thus never shuffled one by one, only a row for
each word of a block, and no word table is held whole by any task or by the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioguard.llm.bpe import IntTable
from folioguard.llm.common import fold, release
from folioguard.session import materialize

BLOCK_WORDS = 400_000
SEGMENT = 256  # bytes: no piece runs over a multiple of this inside a word
ROUNDS = 3
PRIOR_TOKENS = 1_000.0
WORDS_AT_ONCE = 4_096
MARK = "▁"
NOT_YET = -np.inf


# -- the lattice

class Lattice:
    """Pieces as byte strings in a trie; a word is read with a leading space, which pieces that start a word carry."""

    def __init__(self, pieces: list[bytes], logs: np.ndarray):
        children: dict[int, int] = {}
        ends = [-1]
        for number, piece in enumerate(pieces):
            node = 0
            for byte in piece:
                key = node << 8 | byte
                nxt = children.get(key)
                if nxt is None:
                    nxt = children[key] = len(ends)
                    ends.append(-1)
                node = nxt
            ends[node] = number
        self.edges = IntTable(np.fromiter(children, dtype=np.int64, count=len(children)),
                              np.fromiter(children.values(), dtype=np.int64, count=len(children)))
        self.ends = np.array(ends, dtype=np.int32)
        self.deepest = max(map(len, pieces))
        self.logs = logs

    def arcs(self, table: np.ndarray, lengths: np.ndarray, start: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Pieces that begin at ``start``: (length, rows, piece numbers) for each length that some row has."""
        rows = np.flatnonzero(lengths > start)
        node = np.zeros(len(rows), dtype=np.int64)
        for depth in range(1, min(self.deepest, table.shape[1] - start, SEGMENT - start % SEGMENT) + 1):
            node = self.edges.get(node << 8 | table[rows, start + depth - 1]).astype(np.int64)
            alive = (node >= 0) & (lengths[rows] >= start + depth)
            rows, node = rows[alive], node[alive]
            if not len(rows):
                return
            piece = self.ends[node]
            met = piece >= 0
            if met.any():
                yield depth, rows[met], piece[met]

    def forward(self, table: np.ndarray, lengths: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Log of the summed probability of all segmentations up to each place."""
        alpha = np.full((len(table), table.shape[1] + 1), NOT_YET)
        alpha[:, 0] = 0.0
        for start in range(table.shape[1]):
            for depth, rows, piece in self.arcs(table, lengths, start):
                alpha[rows, start + depth] = np.logaddexp(
                    alpha[rows, start + depth], alpha[rows, start] + self.logs[piece])
                if keep is not None:
                    keep.append((start, depth, rows, piece))
        return alpha

    def word_logs(self, words: list[bytes]) -> np.ndarray:
        """Natural log of each word's marginal probability."""
        out = np.zeros(len(words))
        for some, table, lengths in _tables(words):
            out[some] = self.forward(table, lengths)[np.arange(len(some)), lengths]
        return out

    def expected(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece in ``words``, met ``counts`` times."""
        total = np.zeros(len(self.logs))
        for some, table, lengths in _tables(words):
            kept: list = []
            alpha = self.forward(table, lengths, kept)
            rows_all = np.arange(len(some))
            whole = alpha[rows_all, lengths]
            beta = np.full(alpha.shape, NOT_YET)
            beta[rows_all, lengths] = 0.0
            for start, depth, rows, piece in reversed(kept):
                through = self.logs[piece] + beta[rows, start + depth]
                share = np.exp(alpha[rows, start] + through - whole[rows]) * counts[some[rows]]
                total += np.bincount(piece, weights=share, minlength=len(total))
                beta[rows, start] = np.logaddexp(beta[rows, start], through)
        return total


def _tables(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Words of like length as rows of bytes behind a space, a bounded number of bytes at a time."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):
        n = max(1, min(WORDS_AT_ONCE, int(WORDS_AT_ONCE * 64 // (sizes[order[at]] + 1))))
        some = order[at : at + n]
        some = some[sizes[some] <= 2 * sizes[some[0]] + 16]
        lengths = sizes[some] + 1
        table = np.zeros((len(some), int(lengths.max())), dtype=np.int64)
        table[np.arange(table.shape[1]) < lengths[:, None]] = np.frombuffer(
            b"".join([b" " + words[i] for i in some.tolist()]), dtype=np.uint8)
        yield some, table, lengths
        at += len(some)


def starting_pieces(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces of a sentencepiece model and their starting probabilities.

    Its scores fall by one from merge to merge, so they are ranks: a piece starts with one over its rank. The model's
    256 bytes come last, as its lowest scores. Pieces with white space or capitals inside a word never match and stay out.
    """
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    chances: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            continue
        name = model.id_to_piece(i)
        if model.is_byte(i):
            data, chance = bytes([int(name[3:5], 16)]), 1 / (2 + model.get_piece_size())
        else:
            data = name.encode("utf-8")
            data = b" " + data[3:] if name.startswith(MARK) else data
            if MARK.encode() in data or data != data.lower() or len(data) > SEGMENT or len((b"x" + data[1:]).split()) > 1:
                continue
            chance = 1 / (1 + max(0.0, -model.get_score(i)))
        chances[data] = chances.get(data, 0.0) + chance
    for b in range(256):
        chances.setdefault(bytes([b]), 1 / (2 + model.get_piece_size()))
    start = np.array(list(chances.values()))
    return list(chances), start / start.sum()


# -- words of blocks

BLOCK_KINDS = {"block": pa.int64(), "held_out": pa.bool_(), "n_words": pa.int64(), "numbers": pa.binary(),
               "words": pa.binary(), "counts": pa.binary()}
BLOCK_FIELDS = "block bigint, held_out boolean, n_words bigint, numbers binary, words binary, counts binary"


def _packed_numbers(ids: np.ndarray, times: np.ndarray) -> bytes:
    """Sorted numbers as differences, then how often each; bytes of one place together, which packs well."""
    both = np.concatenate([np.diff(ids, prepend=0), times]).astype("<u4")
    return zstandard.compress(both.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked_numbers(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(blob), dtype=np.uint8).reshape(4, -1)
    both = np.ascontiguousarray(raw.T).view("<u4").reshape(-1).astype(np.int64)
    half = len(both) // 2
    return np.cumsum(both[:half]), both[half:]


def block_words(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row for each document (its words by number in its block) and one for each block (its words, one a line, and
    their counts in training documents). ``docs`` has key, text and held_out."""
    kind = docs.schema["key"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        task, chunk = TaskContext.get().partitionId(), 0
        number: dict[bytes, int] = {}
        seen = np.zeros(1 << 16, dtype=np.int64)

        def block() -> int:
            return task << 32 | chunk

        def of_block(key_type: pa.DataType) -> pa.RecordBatch:
            made = {"block": [block()], "held_out": [None], "n_words": [None], "numbers": [None],
                    "words": [zstandard.compress(b"\n".join(number), 3)],
                    "counts": [zstandard.compress(seen[: len(number)].tobytes(), 3)]}
            return pa.RecordBatch.from_arrays(
                [pa.nulls(1, key_type), *[pa.array(made[c], type=t) for c, t in BLOCK_KINDS.items()]],
                names=["key", *BLOCK_KINDS])

        key_type = None
        for batch in batches:
            key_type = batch.schema.field("key").type
            for first in range(0, batch.num_rows, 512):
                some = batch.slice(first, 512)
                out: dict[str, list] = {c: [] for c in BLOCK_KINDS}
                for text, held in zip(some.column("text").to_pylist(), some.column("held_out").to_pylist()):
                    words = text.encode("utf-8").lower().split()
                    ids = np.fromiter([number.setdefault(w, len(number)) for w in words], dtype=np.int64, count=len(words))
                    ids, times = np.unique(ids, return_counts=True)
                    if len(number) > len(seen):
                        seen = np.concatenate([seen, np.zeros(max(len(seen), len(number)), dtype=np.int64)])
                    if not held:
                        seen[ids] += times
                    for c, v in zip(BLOCK_KINDS, (block(), held, len(words), _packed_numbers(ids, times), None, None)):
                        out[c].append(v)
                yield pa.RecordBatch.from_arrays(
                    [some.column("key"), *[pa.array(out[c], type=t) for c, t in BLOCK_KINDS.items()]],
                    names=["key", *BLOCK_KINDS])
                if len(number) >= block_words:
                    yield of_block(key_type)
                    number, seen, chunk = {}, np.zeros(1 << 16, dtype=np.int64), chunk + 1
        if number:
            yield of_block(key_type)

    return docs.select("key", "text", "held_out").mapInArrow(run, f"key {kind.simpleString()}, {BLOCK_FIELDS}")


def listed_words(blocks: DataFrame) -> DataFrame:
    """word, c, block and place: a row for each word of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for block, words, counts in zip(*[batch.column(c).to_pylist() for c in ("block", "words", "counts")]):
                names = zstandard.decompress(words).split(b"\n")
                seen = np.frombuffer(zstandard.decompress(counts), dtype=np.int64)
                for at in range(0, len(names), 50_000):
                    part = names[at : at + 50_000]
                    yield pa.RecordBatch.from_pydict({
                        "word": pa.array(part, type=pa.binary()), "c": seen[at : at + 50_000],
                        "block": np.full(len(part), block), "place": np.arange(at, at + len(part), dtype=np.int32)})

    return blocks.where("words is not null").select("block", "words", "counts").mapInArrow(
        run, "word binary, c bigint, block bigint, place int")


# -- model

@dataclass
class Model:
    """Piece and end probabilities, and the corpus figures that base scores need."""

    pieces: list[bytes]
    logs: np.ndarray
    end_log: float
    train_tokens: int
    vocabulary: int
    end_count: int

    def base(self, c: np.ndarray | int) -> np.ndarray:
        return np.log10((c + 1) / (self.train_tokens + self.vocabulary + 1))


def train(words: DataFrame, end_count: int, path: str, rounds: int = ROUNDS) -> Model:
    """Expectation-maximisation over ``words`` (word, c), all of them with their training counts.

    Each round sums the pieces' expected counts in tasks; only these sums, one for each piece, reach the driver.
    ``PRIOR_TOKENS`` imaginary tokens keep the starting probabilities in play, so nothing becomes impossible.
    """
    spark = words.sparkSession
    pieces, start = starting_pieces(path)
    total, distinct = words.where("c > 0").agg(F.sum("c"), F.count(F.lit(1))).first()
    total = total or 0
    chances = start
    pool = spark.sparkContext.broadcast(pieces)  # as many as the vocabulary file has
    for _ in range(rounds if total else 0):
        logs = np.log(chances)

        def run(batches: Iterator[pa.RecordBatch], logs=logs) -> Iterator[pa.RecordBatch]:
            lattice = Lattice(pool.value, logs)
            sums = np.zeros(len(logs))
            for batch in batches:
                c = batch.column("c").to_numpy()
                sums += lattice.expected(batch.column("word").to_pylist(), c)
            used = np.flatnonzero(sums)
            yield pa.RecordBatch.from_pydict({"piece": used, "n": sums[used]})

        rows = words.where("c > 0").select("word", "c").mapInArrow(run, "piece bigint, n double").groupBy("piece").agg(
            F.sum("n").alias("n")).collect()
        counts = PRIOR_TOKENS * start
        for piece, n in rows:
            counts[piece] += n
        chances = counts / counts.sum()
    uses = (counts.sum() if total and rounds else PRIOR_TOKENS)
    end = (end_count + 1) / (uses + end_count + 1)
    return Model(pieces, np.log(chances) + math.log1p(-end), math.log(end), total + end_count,
                 (distinct or 0) + (end_count > 0), end_count)


def word_scores(words: DataFrame, model: Model) -> DataFrame:
    """block, place, c, base and lattice (log10) of every word in every block that has it."""
    pool = words.sparkSession.sparkContext.broadcast((model.pieces, model.logs))
    tokens, vocabulary = model.train_tokens, model.vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        lattice = Lattice(*pool.value)
        for batch in batches:
            c = batch.column("c").to_numpy()
            base = np.log10((c + 1) / (tokens + vocabulary + 1))
            logs = lattice.word_logs(batch.column("word").to_pylist()) / math.log(10)
            homes = batch.column("homes")
            n = np.diff(homes.offsets.to_numpy())
            flat = homes.flatten()
            yield pa.RecordBatch.from_pydict({
                "block": flat.field("block"), "place": flat.field("place"), "known": np.repeat(c > 0, n),
                "base": np.repeat(base, n), "lattice": np.repeat(logs, n)})

    return words.select("word", "c", "homes").mapInArrow(
        run, "block bigint, place int, known boolean, base double, lattice double")


def score_documents(
    docs: DataFrame, path: str, key: str = "doc_id", folds: int = 7, held_out: int = 2, block_size: int = BLOCK_WORDS
) -> DataFrame:
    """``key``, held_out, n_tokens, n_known, train_tokens, base_score and score of every text.

    Null and empty texts are an end alone. Rows without an id are not held out. Repeated rows count and come out as
    often as they are there. An empty table gives no rows.
    """
    rows = docs.select(
        F.col(f"`{key}`").alias("key"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
        F.coalesce(fold(F.col(f"`{key}`"), folds) == held_out, F.lit(False)).alias("held_out"))
    blocks = materialize(block_words(rows, block_size), "lm-blocks")
    coded = blocks.where("numbers is not null").drop("words", "counts")
    words = materialize(listed_words(blocks).groupBy("word").agg(
        F.sum("c").alias("c"), F.collect_list(F.struct("block", "place")).alias("homes")), "lm-words")
    model = train(words, coded.where("not held_out").count(), path)
    scores = word_scores(words, model)
    end_base, end_log, end_known = float(model.base(model.end_count)), model.end_log / math.log(10), model.end_count > 0
    tokens = model.train_tokens
    kind = rows.schema["key"].dataType.simpleString()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        size = (right.column("place").to_numpy().max() + 1) if right.num_rows else 0
        place = right.column("place").to_numpy()
        base, logs, known = np.zeros(size), np.zeros(size), np.zeros(size, dtype=bool)
        base[place], logs[place] = right.column("base").to_numpy(), right.column("lattice").to_numpy()
        known[place] = right.column("known").to_numpy()
        out: dict[str, list] = {"n_known": [], "base_score": [], "score": []}
        for blob in left.column("numbers").to_pylist():
            ids, times = unpacked_numbers(blob)
            out["n_known"].append(int(times[known[ids]].sum()) + end_known)
            out["base_score"].append(float(base[ids] @ times) + end_base)
            out["score"].append(float(logs[ids] @ times) + end_log)
        return pa.table({
            "key": left.column("key"), "held_out": left.column("held_out"),
            "n_tokens": pa.array(left.column("n_words").to_numpy() + 1, type=pa.int64()),
            "n_known": pa.array(out["n_known"], type=pa.int64()),
            "train_tokens": pa.array([tokens] * left.num_rows, type=pa.int64()),
            "base_score": pa.array(out["base_score"], type=pa.float64()),
            "score": pa.array(out["score"], type=pa.float64())})

    scored = coded.groupBy("block").cogroup(scores.groupBy("block")).applyInArrow(
        run, f"key {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
        "base_score double, score double")
    return scored.withColumnRenamed("key", key)
