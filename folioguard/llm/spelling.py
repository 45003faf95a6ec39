"""Grouping spelling variants by reduced-alphabet generation.

Every letter is hashed to one of a few symbols. The full one-edit neighbourhood of each reduced word (itself, each symbol
inserted, deleted or replaced) is generated and joined with the reduced vocabulary; an edit of a word is an edit of its
reduced form or leaves it as it is, so no pair is missed. Only words whose reduced forms met are compared as written.

A reduced word travels as a 64-bit polynomial hash, from which the hashes of its neighbours follow by arithmetic on
arrays. Hashes that collide bring candidates to compare, never lose one. The vocabulary, not the text, is what is joined:
its growth is slower than the corpus', and a bucket holds about the vocabulary by length over ``SYMBOLS`` to that length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioguard.llm.common import pick, release, small_batches
from folioguard.session import materialize

SYMBOLS = 8
RUN = "[A-Za-zÀ-ÿ]+"
LEAST_LENGTH = 6
LEAST_COUNT = 5
LEAST_RATIO = 5
GARBLED = 199  # one in so many words of a document loses a letter
HELD_WORDS = 300_000
LONG_TEXT = 1_000_000
WORDS_AT_ONCE = 2_000
_mix = np.random.default_rng(11)
CODES = _mix.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = int(_mix.integers(1 << 40, 1 << 62)) * 4 + 3
FORWARD, BACK = np.uint64(BASE), np.uint64(pow(BASE, -1, 1 << 64))


def word_counts(docs: DataFrame, garbled: int = GARBLED, least_length: int = LEAST_LENGTH) -> DataFrame:
    """word, n: runs of letters, A-Z in lower case, of at least ``least_length`` code points.

    Let h be the crc32 of ``<doc_id>:<word>``; where ``garbled`` divides it, the word loses its code point h modulo its
    length (0: none does). Null texts have no words; a null doc_id is written as nothing. Words are counted before the
    shuffle, so a common one is a row a task. Texts over a million code points are read word by word.
    """
    runs = re.compile(RUN)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        counts: Counter = Counter()

        def emit() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(counts), type=pa.string()), pa.array(list(counts.values()), type=pa.int64())],
                names=["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                low = text.encode().lower().decode()
                words = runs.findall(low) if len(low) < LONG_TEXT else (m[0] for m in runs.finditer(low))
                seed = zlib.crc32(f"{key}:".encode())
                for word, n in Counter(words).items():
                    size = len(word)
                    if size < least_length:
                        continue
                    if garbled and (h := zlib.crc32(word.encode(), seed)) % garbled == 0:
                        h %= size
                        word = word[:h] + word[h + 1 :]
                        if size == least_length:
                            continue
                    counts[word] += n
                if len(counts) > HELD_WORDS:
                    yield emit()
        yield emit()

    rows = pick(docs, ["doc_id", "text"]).where("text is not null").select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"), "text")
    return rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return (x ^ (x >> np.uint64(29))).view(np.int64)


def reduce_words(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the words end to end, a code point modulo ``SYMBOLS`` each, and the words' lengths."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4")
    return (codes % SYMBOLS).astype(np.int64), np.fromiter(map(len, words), dtype=np.int64, count=len(words))


def _powers(sizes: np.ndarray) -> np.ndarray:
    powers = np.full(int(sizes.max(initial=0)) + 2, FORWARD, dtype=np.uint64)
    powers[0] = 1
    return np.multiply.accumulate(powers)


def _sums(symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Place of each symbol in its word, its weight, the word's hash before it, and the words' hashes."""
    ends = np.cumsum(sizes)
    place = np.arange(len(symbols)) - np.repeat(ends - sizes, sizes)
    weight = _powers(sizes)[place]
    running = np.append(np.uint64(0), np.cumsum(CODES[symbols] * weight))
    first = running[ends - sizes]
    return place, weight, running[:-1] - np.repeat(first, sizes), running[ends] - first


def reduced_keys(symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return scramble(_sums(symbols, sizes)[3])


def neighbourhood(symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word number and key of every reduced word within one edit of each word, itself included, each once: a symbol is
    deleted at the end of a run of equal ones, and inserted before a different one or at the end."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    _, weight, before, total = _sums(symbols, sizes)
    rest = total[owner] - before  # the symbol itself and all after it
    own = CODES[symbols] * weight
    last = np.append(owner[1:] != owner[:-1], True) if len(owner) else np.zeros(0, dtype=bool)
    run_end = last.copy()
    run_end[:-1] |= symbols[1:] != symbols[:-1]
    owners, keys = [np.arange(len(sizes))], [total]
    owners.append(owner[run_end])
    keys.append((before + (rest - own) * BACK)[run_end])
    end_weight = _powers(sizes)[sizes]
    for symbol in range(SYMBOLS):
        other = symbols != symbol
        code = CODES[symbol]
        owners += [owner[other], owner[other], np.arange(len(sizes))]
        keys += [(total[owner] + code * weight - own)[other], (before + code * weight + rest * FORWARD)[other],
                 total + code * end_weight]
    return np.concatenate(owners), scramble(np.concatenate(keys))


def _with_keys(vocabulary: DataFrame) -> DataFrame:
    """word, n, key and the reduced word itself as ``reduced``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            symbols, sizes = reduce_words(batch.column("word").to_pylist())
            letters = (symbols + 48).astype(np.uint8)
            ends = np.cumsum(sizes)
            reduced = pa.LargeStringArray.from_buffers(
                len(sizes), pa.py_buffer(np.append(0, ends).astype(np.int64)), pa.py_buffer(letters.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("word"), batch.column("n"), pa.array(reduced_keys(symbols, sizes)), reduced.cast(pa.string())],
                names=["word", "n", "key", "reduced"])

    return vocabulary.select("word", "n").mapInArrow(run, "word string, n bigint, key bigint, reduced string")


def _probes(reduced: DataFrame) -> DataFrame:
    """key and probe: the keys of the full one-edit neighbourhood of every reduced word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            words, keys = batch.column("reduced").to_pylist(), batch.column("key").to_numpy()
            at = 0
            while at < len(words):
                upto, size = at, 0
                while upto < len(words) and upto < at + WORDS_AT_ONCE and size < 20 * WORDS_AT_ONCE:
                    size += len(words[upto])
                    upto += 1
                codes = np.frombuffer("".join(words[at:upto]).encode(), dtype=np.uint8).astype(np.int64) - 48
                owner, probe = neighbourhood(
                    codes, np.fromiter(map(len, words[at:upto]), dtype=np.int64, count=upto - at))
                yield pa.RecordBatch.from_arrays([pa.array(keys[at:upto][owner]), pa.array(probe)], names=["key", "probe"])
                at = upto

    return reduced.select("key", "reduced").mapInArrow(run, "key bigint, probe bigint")


def _by_merge(side: DataFrame) -> DataFrame:
    """``side`` for a join that is never by broadcast: it is as long as the vocabulary, and Spark sizes it by its compressed
    file, or probes by the words they come from, a hundredth of them."""
    return side.hint("merge")


def near_words(vocabulary: DataFrame) -> DataFrame:
    """word, n, other, other_n: every ordered pair of distinct words of ``vocabulary`` (word, n) that differ by exactly
    one inserted, deleted or replaced code point."""
    words = materialize(_with_keys(vocabulary), "reduced-words")
    known = words.select(F.col("key").alias("other_key")).distinct()
    pairs = materialize(
        _probes(words.select("key", "reduced").distinct()).join(_by_merge(known), F.col("probe") == F.col("other_key"))
        .select("key", "other_key").distinct(), "reduced-pairs")
    others = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"), F.col("key").alias("of_key"))
    return words.drop("reduced").join(_by_merge(pairs), "key").join(
        _by_merge(others), (F.col("other_key") == F.col("of_key")) & (F.levenshtein("word", "other", 1) == 1)).select(
        "word", "n", "other", "other_n")


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: forms followed to the last by pointer doubling. A form's count is at least ``LEAST_RATIO`` times that
    of the word, so chains are short and have no circles."""
    roots = materialize(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = roots.select(F.col("word").alias("at"), F.col("root").alias("further"))
        stepped = roots.join(_by_merge(onward), F.col("root") == F.col("at"), "left")
        moved = materialize(
            stepped.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("m")),
            "roots")
        if not moved.where("m").limit(1).count():
            return moved.drop("m")
        roots = moved.drop("m")


def variants(counts: DataFrame, least_count: int = LEAST_COUNT, least_ratio: int = LEAST_RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of ``counts`` (word, n; distinct words) met ``least_count`` times.

    A word's form is its near word of largest n (ties: the first in code-point order) if that n is at least
    ``least_ratio`` times the word's; else form and form_n are null. The root follows forms to the last, the word itself
    if it has none. Null words are left out; an empty table gives no rows.
    """
    vocabulary = materialize(counts.where(f"n >= {int(least_count)} and word is not null").select("word", "n"), "vocabulary")
    best = near_words(vocabulary).groupBy("word", "n").agg(
        F.count(F.lit(1)).alias("n_near"),
        F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other"))).alias("best"))
    common = -F.col("best.minus") >= F.lit(least_ratio) * F.col("n")
    near = materialize(best.select(
        F.col("word").alias("of_word"), "n_near", F.when(common, F.col("best.other")).alias("form"),
        F.when(common, -F.col("best.minus")).alias("form_n")), "near-words")
    roots = _roots(near.where("form is not null").select(F.col("of_word").alias("word"), "form"))
    return vocabulary.join(_by_merge(near), F.col("word") == F.col("of_word"), "left").drop("of_word").join(
        _by_merge(roots), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), "form_n")


CRC_TABLE = """[list_reduce([n] || range(8)::UBIGINT[], lambda c, i: CASE WHEN c % 2 = 1 THEN xor(3988292384::UBIGINT, c // 2)
    ELSE c // 2 END) FOR n IN [x::UBIGINT FOR x IN range(256)]]"""

ORACLE = rf"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT {CRC_TABLE} AS steps),
runs AS MATERIALIZED (
    SELECT coalesce(doc_id::VARCHAR, '') AS key, w, count(*) AS n FROM (
        SELECT doc_id, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS w
        FROM documents) WHERE length(w) >= 6 GROUP BY ALL),
hashed AS (
    SELECT w, n, xor(4294967295::UBIGINT, list_reduce([4294967295::UBIGINT] || flatten(list_transform(
        string_split(key || ':' || w, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::UBIGINT]
            ELSE [195::UBIGINT, (ord(c) - 64)::UBIGINT] END)),
        lambda c, b: xor(steps[(xor(c, b) % 256)::BIGINT + 1], c // 256))) AS h
    FROM runs, crc),
counts AS (
    SELECT CASE WHEN h % 199 = 0 THEN w[:(h % length(w))::BIGINT] || w[(h % length(w))::BIGINT + 2:] ELSE w END AS word,
        sum(n)::BIGINT AS n
    FROM hashed GROUP BY ALL),
vocabulary AS MATERIALIZED (SELECT * FROM counts WHERE length(word) >= 6 AND n >= 5),
cut AS MATERIALIZED (
    SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest
    FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocabulary)),
pairs AS MATERIALIZED (
    SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM cut a JOIN cut b
        ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN vocabulary b ON a.rest = b.word
    UNION SELECT b.word, b.n, a.word, a.n FROM cut a JOIN vocabulary b ON a.rest = b.word),
near AS (
    SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS best, max(other_n) AS best_n, any_value(n) AS n
    FROM pairs GROUP BY word),
formed AS MATERIALIZED (
    SELECT word, n_near, CASE WHEN best_n >= 5 * n THEN best END AS form, CASE WHEN best_n >= 5 * n THEN best_n END AS form_n
    FROM near),
follow AS (
    SELECT word, form AS last, 1 AS step FROM formed WHERE form IS NOT NULL
    UNION ALL SELECT f.word, g.form, step + 1 FROM follow f JOIN formed g ON f.last = g.word WHERE g.form IS NOT NULL),
roots AS (SELECT word, arg_max(last, step) AS root FROM follow GROUP BY word)
SELECT v.word, form, coalesce(root, v.word) AS root, v.n, coalesce(n_near, 0)::BIGINT AS n_near, form_n
FROM vocabulary v LEFT JOIN formed USING (word) LEFT JOIN roots USING (word)
"""
