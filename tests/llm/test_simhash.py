from __future__ import annotations

import random
import re
from itertools import combinations

import corpus_pipeline as cp
import numpy as np
import pyarrow as pa
import pytest
import xxhash

from folioguard.llm import simhash
from folioguard.llm.components import components


def plain_fingerprint(text, shingle):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    grams = [b" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in pairs:
        parent[find(a)] = find(b)
    out = {}
    for n in nodes:
        out.setdefault(find(n), set()).add(n)
    return {frozenset(v) for v in out.values()}


def near_pairs(values, bits):
    array = np.array(values, dtype=np.uint64)
    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(array[i + 1 :] ^ array[i]) <= bits):
            yield values[i], values[i + 1 + int(j)]


def clustered(rnd, n):
    values = {rnd.getrandbits(64) for _ in range(n)}
    for start in list(values)[: n // 3]:
        at = start
        for _ in range(rnd.randint(0, 20)):
            new = at
            for _ in range(rnd.randint(1, 6)):
                new ^= 1 << rnd.randrange(64)
            values.add(new)
            at = new if rnd.random() < 0.3 else at
    return sorted(values)


@pytest.mark.parametrize("bits", [1, 3, 4, 5])
def test_every_near_pair_meets_in_a_posting(bits):
    sets = simhash.posting_sets(bits)
    for changed in combinations(range(8), bits):
        assert any(not set(changed) & set(s) for s in sets)
    if bits == 3:
        assert len(sets) == 14


@pytest.mark.parametrize("bits, size", [(3, 1), (3, 7), (3, 10**6), (5, 50)])
def test_posting_links_connect_what_near_pairs_connect(bits, size):
    values = clustered(random.Random(bits), 90)
    rows = []
    for k, positions in enumerate(simhash.posting_sets(bits)):
        for v in values:
            key = k
            for p in positions:
                key = key << 8 | (v >> (8 * p) & 255)
            rows.append((key, v))
    rows.sort()
    batches = [pa.RecordBatch.from_pydict({
        "posting": np.array([r[0] for r in rows[i : i + size]], dtype=np.int64),
        "fp": np.array([r[1] for r in rows[i : i + size]], dtype=np.uint64).view(np.int64),
    }) for i in range(0, len(rows), size)]
    links = [(int(a), int(b)) for out in simhash._posting_links(iter(batches), bits)
             for a, b in zip(out.column(0).to_numpy().view(np.uint64), out.column(1).to_numpy().view(np.uint64))]
    assert all(bin(a ^ b).count("1") <= bits for a, b in links)
    assert classes(values, links) == classes(values, near_pairs(values, bits))


def test_looking_partners_up_gives_the_same_forest(monkeypatch):
    rnd = random.Random(6)
    values = np.unique(np.array([rnd.getrandbits(13) << 20 for _ in range(4_000)], dtype=np.uint64))
    a, b = simhash.forest(values, 3)
    monkeypatch.setattr(simhash, "LOOK_UP_FROM", 10)
    x, y = simhash.forest(values, 3)
    nodes = values.tolist()
    assert classes(nodes, zip(a.tolist(), b.tolist())) == classes(nodes, zip(x.tolist(), y.tolist()))


def test_components(spark):
    rnd = random.Random(1)
    links = [(i, i + 1) for i in range(100, 160)] + [(rnd.randrange(400, 500), rnd.randrange(400, 500)) for _ in range(70)]
    links += [(7, 7), (900, 901), (901, 900)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {n for a, b in links if a != b for n in (a, b)}
    for group in classes(nodes, [(a, b) for a, b in links if a != b]):
        assert {got.get(n, n) for n in group} == {min(group)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("shingle, bits", [(3, 3), (5, 5)])
def test_groups_against_all_pairs(spark, shingle, bits):
    rnd = random.Random(shingle)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(40):
        base = [rnd.choice(words) for _ in range(rnd.choice([0, 1, 2, 4, 30, 200]))]
        for _ in range(rnd.randint(1, 4)):
            copy = list(base)
            if copy and rnd.random() < 0.7:
                copy[rnd.randrange(len(copy))] = rnd.choice(words).upper()
            rows.append((len(rows) * 7 % 1_000, " ".join(copy)))
    got = simhash.groups(spark.createDataFrame(rows, "doc_id long, text string"), shingle, bits).collect()
    prints = {d: plain_fingerprint(t, shingle) for d, t in rows}
    assert {r["doc_id"]: r["fp"] % 2**64 for r in got} == prints
    by_print = classes(set(prints.values()), near_pairs(sorted(set(prints.values())), bits))
    expected = {d: min(x for x, p in prints.items() if p in group) for group in by_print
                for d in [x for x, p in prints.items() if p in group]}
    assert {r["doc_id"]: r["component_id"] for r in got} == expected


def test_odd_rows(odd_docs, no_docs):
    got = simhash.groups(odd_docs).collect()
    assert len(got) == odd_docs.count()
    empty = [r for r in got if r["fp"] == 0]
    assert {r["doc_id"] for r in empty} == {None, 2, 3, 4} and {r["component_id"] for r in empty} == {2}
    assert {r["component_id"] for r in got if r["doc_id"] == 9} == {9}  # with the row that has no id
    assert simhash.groups(no_docs).count() == 0
    firsts = simhash.first_of_groups(odd_docs, 5, 5)
    assert firsts.columns == odd_docs.columns
    ids = [r["doc_id"] for r in firsts.collect()]
    assert sorted(ids) == sorted({r["component_id"] for r in got}) and simhash.first_of_groups(no_docs, 5, 5).count() == 0


def shingle_sets(rows, shingle):
    out = {}
    for d, text in rows:
        words = text.split()
        out[d] = {tuple(words[i : i + shingle]) for i in range(max(len(words) - shingle + 1, min(len(words), 1)))}
    return out


def test_similar_texts_against_all_pairs(spark):
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3_000)]
    rows = []
    for _ in range(60):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([0, 3, 20, 60, 150, 400]))]
        for _ in range(rnd.randint(1, 6)):
            share = rnd.choice([0, 0.01, 0.02, 0.03, 0.05])
            rows.append((len(rows), " ".join(rnd.choice(vocabulary) if rnd.random() < share else w for w in base)))
    sets = shingle_sets(rows, 5)
    alike = {(a, b): len(sets[a] & sets[b]) / max(len(sets[a] | sets[b]), 1) for a, b in combinations(sets, 2)}
    pairs = [p for p, x in alike.items() if x >= 0.8 or not (sets[p[0]] or sets[p[1]])]
    prints = {d: simhash.fingerprint(t, 5) for d, t in rows}
    assert sum(0.8 <= alike[p] < 1 and (prints[p[0]] ^ prints[p[1]]).bit_count() > 5 for p in pairs) > 20
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"] for r in cp.drop_near_duplicates(spark, docs, "").collect()}
    assert got == {min(group) for group in classes(sets, pairs)}


def test_near_fingerprints_of_unlike_texts_stay(spark):
    words = [f"w{i}" for i in range(12)]
    rows = [(1, " ".join(words * 40)), (2, " ".join(words * 40 + ["x", "y", "z", "u", "v"]))]
    a, b = shingle_sets(rows, 5).values()
    assert len(a & b) / len(a | b) < 0.8
    assert (simhash.fingerprint(rows[0][1], 5) ^ simhash.fingerprint(rows[1][1], 5)).bit_count() <= 5
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert cp.drop_near_duplicates(spark, docs, "").count() == 2


def test_similar_odd_rows(odd_docs, no_docs):
    firsts = simhash.first_of_similar(odd_docs, 5, 5, 0.8)
    assert firsts.columns == odd_docs.columns
    ids = [r["doc_id"] for r in firsts.collect()]
    assert sorted(ids) == [1, 2, 5, 6, 7, 8, 9, 10, 2**60 + 1]
    assert simhash.first_of_similar(no_docs, 5, 5, 0.8).count() == 0
