from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from folioguard.llm import lattice

PATH = public_tokenizers.path("piece_bpe_32k.model")
PIECES = [b" ", b" a", b"a", b"b", b"ab", b" ab", b"ba", b"bab"] + [bytes([c]) for c in range(256) if c not in b" ab"]
WORDS = [b"a", b"ab", b"abab", b"bbaba", b"xab", "é".encode(), b"babab" * 4, b"ab" * 200]


@pytest.fixture(scope="module")
def chances():
    p = np.random.default_rng(1).random(len(PIECES))
    return p / p.sum()


def plain_log(word, chances, segment=lattice.SEGMENT):
    own, s = dict(zip(PIECES, chances)), b" " + word
    alpha = [0.0] * (len(s) + 1)
    alpha[0] = 1.0
    scale = 0.0
    for i in range(len(s)):
        for j in range(i + 1, min(len(s), i + 4) + 1):
            if s[i:j] in own and (i // segment == (j - 1) // segment):
                alpha[j] += alpha[i] * own[s[i:j]]
        if 0 < alpha[i + 1] < 1e-100:
            alpha = [a * 1e100 for a in alpha]
            scale += 100 * math.log(10)
    return math.log(alpha[-1]) - scale


def test_forward_sums_over_all_segmentations(chances):
    got = lattice.Lattice(PIECES, np.log(chances)).word_logs(WORDS)
    assert np.allclose(got, [plain_log(w, chances) for w in WORDS])


def test_expected_counts_are_the_slope_of_the_likelihood(chances):
    counts = np.arange(1.0, len(WORDS) + 1)
    expected = lattice.Lattice(PIECES, np.log(chances)).expected(WORDS, counts)
    for k in (0, 1, 2, 4, 6, 7):
        up, down = np.log(chances), np.log(chances)
        up[k] += 1e-5
        down[k] -= 1e-5
        slope = (lattice.Lattice(PIECES, up).word_logs(WORDS) - lattice.Lattice(PIECES, down).word_logs(WORDS)) @ counts / 2e-5
        assert expected[k] == pytest.approx(slope, rel=1e-5)


def test_starting_pieces_cover_every_byte_and_sum_to_one():
    pieces, start = lattice.starting_pieces(PATH)
    assert start.sum() == pytest.approx(1) and len(set(pieces)) == len(pieces) > 10_000
    assert {bytes([b]) for b in range(256)} <= set(pieces)


def test_numbers_round_trip():
    ids, times = np.array([0, 5, 70_000, 3_000_000]), np.array([1, 400, 2, 70_000])
    a, b = lattice.unpacked_numbers(lattice._packed_numbers(ids, times))
    assert a.tolist() == ids.tolist() and b.tolist() == times.tolist()
    empty = lattice.unpacked_numbers(lattice._packed_numbers(ids[:0], times[:0]))
    assert [len(x) for x in empty] == [0, 0]


def tokens(text):
    return [*re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower()), b"</end>"]


@pytest.mark.parametrize("block", [3, 400_000])
def test_figures_against_plain_counting(spark, odd_docs, block):
    got = lattice.score_documents(odd_docs, PATH, block_size=block).collect()
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    held = {d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows}
    seen = Counter(w for d, t in rows if not held[d] for w in tokens(t))
    total, kinds = sum(seen.values()), len(seen)
    expected = sorted((str(d), held[d], len(tokens(t)), sum(seen[w] > 0 for w in tokens(t)), total, round(sum(
        math.log10((seen[w] + 1) / (total + kinds + 1)) for w in tokens(t)), 3)) for d, t in rows)
    assert sorted((str(r["doc_id"]), *r[1:5], round(r["base_score"], 3)) for r in got) == expected
    assert all(r["score"] < 0 for r in got)


def test_blocks_do_not_change_scores_and_training_helps(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    whole = {r["doc_id"]: r for r in lattice.score_documents(docs, PATH).collect()}
    cut = {r["doc_id"]: r for r in lattice.score_documents(docs.repartition(3), PATH, block_size=500).collect()}
    assert all(cut[d]["score"] == pytest.approx(r["score"], rel=1e-6) for d, r in whole.items())
    pieces, start = lattice.starting_pieces(PATH)
    untrained = lattice.Lattice(pieces, np.log(start))
    held = [r for r in whole.values() if r["held_out"]][:20]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    before = sum(untrained.word_logs(texts[r["doc_id"]].encode().lower().split()).sum() / math.log(10) for r in held)
    assert sum(r["score"] for r in held) > before


def test_empty_table(no_docs):
    assert lattice.score_documents(no_docs, PATH).count() == 0
