from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioguard.llm import repeats
from folioguard.llm.queries import QUERIES


def plain(rows, size):
    met = Counter()
    for _, text in rows:
        data = (text or "").encode()
        met.update(data[p : p + size] for p in range(len(data) - size + 1))
    out = []
    for doc_id, text in rows:
        data = (text or "").encode()
        covered = np.zeros(len(data) + 1, dtype=bool)
        for p in range(len(data) - size + 1):
            if met[data[p : p + size]] > 1:
                covered[p : p + size] = True
        kept = bytes(np.frombuffer(data, dtype=np.uint8)[~covered[:-1]])
        spans = int((covered[:-1] & ~np.concatenate([[False], covered[:-1]])[:-1]).sum()) if data else 0
        out.append((str(doc_id), len(data), int(covered.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def stripped(docs, **options):
    got = repeats.strip_repeats(docs, **options).select(
        F.col("doc_id").cast("string"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    return sorted((str(r[0]), *r[1:]) for r in got.collect())


def invented(seed, letters):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 300))) for _ in range(6)]
    rows = []
    for i in range(60):
        text = ""
        for _ in range(rnd.randint(0, 4)):
            part = rnd.choice(base)
            at = rnd.randrange(len(part))
            text += part[at : at + rnd.randint(1, 120)] + "".join(rnd.choice("xyz") for _ in range(rnd.randint(0, 3)))
        rows.append((i, text))
    return [*rows, (100, rows[3][1]), (101, rows[3][1])]


@pytest.mark.parametrize("size, letters, members", [
    (20, "abcdefgh", 20_000), (40, "abcé ", 20_000), (40, "abcé ", 2), (8, "ab", 20_000), (20, "a", 3)])
def test_against_plain_search(spark, size, letters, members):
    rows = invented(size, letters)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert stripped(docs, min_len=size, local_members=members) == plain(rows, size)


def test_real_length_on_the_given_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    expected = plain(rows, 400)
    assert stripped(docs) == expected and sum(r[2] for r in expected) > 0


def test_positions_in_chunks_cover_every_window_once(monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 64)
    repeats.hashes.cache_clear()
    lengths = repeats.Lengths(20)
    data = np.frombuffer(bytes(random.Random(1).choice(b"abcd") for _ in range(1_000)), dtype=np.uint8)
    windows = []
    for names, _, lo, to_place, more in repeats.positions(data, lengths):
        for name, first, place, n in zip(names, lo, to_place, more):
            assert 0 <= place <= lengths.span - 1
            windows += range(first, first + n + 1)
    assert windows == list(range(len(data) - 20 + 1))
    repeats.hashes.cache_clear()


def test_odd_rows(odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    short = [(d, t) for d, t in rows if not t or len(t) < 100_000]  # plain search is slow
    assert stripped(odd_docs.where("text is null or length(text) < 100000"), min_len=30) == plain(short, 30)
    whole = {r[0]: r for r in stripped(odd_docs)}
    assert whole["6"][2] == 100_000 and whole["6"][3] == 1  # one letter throughout
    assert stripped(no_docs) == []


def test_cut_characters_leave_no_trace(spark):
    rows = [(1, "é" + "a" * 30 + "é!"), (2, "ê" + "a" * 30 + "ê?")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = [r["kept"] for r in repeats.strip_repeats(docs, min_len=20, as_text=True).orderBy("doc_id").collect()]
    assert texts == ["é!", "ê?"] or texts == ["!", "?"] or all("a" not in t for t in texts)


def test_stretches_with_few_whole_words_stay():
    data = b"one two three four five six"
    assert repeats.whole_words(data, 0, len(data)) == 6
    assert repeats.whole_words(data, 1, len(data)) == 5
    assert repeats.whole_words(data, 3, 13) == 2
    assert repeats.whole_words(data, 5, 15) == 1  # wo three f
    spans = [{"start": 4, "end": 9}, {"start": 8, "end": 18}, {"start": 24, "end": 27}]
    assert repeats.stretches(spans) == [(4, 18), (24, 27)]
    assert repeats.without(data, spans, least_words=3) == (b"one  five six", 1)
    assert repeats.without(data, spans) == (b"one  five ", 2)


def plain_passages(rows, size, words):
    met = Counter()
    for _, text in rows:
        data = (text or "").encode()
        met.update(data[p : p + size] for p in range(len(data) - size + 1))
    out = {}
    for doc_id, text in rows:
        data = (text or "").encode()
        spans = [{"start": p, "end": p + size} for p in range(len(data) - size + 1) if met[data[p : p + size]] > 1]
        sizes = [b - a for a, b in repeats.stretches(spans) if repeats.whole_words(data, a, b) >= words]
        out[str(doc_id)] = (len(sizes), sum(sizes))
    return out


@pytest.mark.parametrize("size, letters, short", [(20, "abcdefgh ", 9), (40, "abcé ", 40), (16, "a ", 8)])
def test_passages_beside_longer_repeats(spark, size, letters, short):
    rows = invented(size, letters)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert stripped(docs, min_len=size, passages=(short, 3)) == plain(rows, size)
    got = repeats.strip_repeats(docs, min_len=size, passages=(short, 3)).collect()
    assert {str(r["doc_id"]): (r["n_passages"], r["n_passage_bytes"]) for r in got} == plain_passages(rows, short, 3)


def test_query_on_the_given_table(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = QUERIES["op5_prefix_doubling_dedup"](spark, sf_dir).collect()
    assert sorted((str(r[0]), *r[1:5]) for r in got) == plain(rows, 400)
    assert {str(r["doc_id"]): (r["n_passages"], r["n_passage_bytes"]) for r in got} == plain_passages(rows, *repeats.PASSAGE)


def test_tables_of_the_rounds_are_gone_when_the_spans_are_written(spark):
    import os

    from folioguard.session import shared_dir

    docs = spark.createDataFrame(invented(20, "abcdefgh"), "doc_id long, text string")
    before = set(os.listdir(shared_dir(spark)))
    found = stripped(docs, min_len=20)
    assert sum(r[2] for r in found) > 0
    assert {name.rsplit("-", 1)[0] for name in set(os.listdir(shared_dir(spark))) - before} == {"spans"}
    before = set(os.listdir(shared_dir(spark)))
    assert stripped(docs, min_len=20, passages=(9, 3)) == found
    assert {name.rsplit("-", 1)[0] for name in set(os.listdir(shared_dir(spark))) - before} == {"spans", "inside-spans"}
