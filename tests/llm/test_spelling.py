from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from folioguard.llm import spelling
from folioguard.llm.queries import ORACLES, QUERIES


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def by_hand(counts: dict[str, int], least: int = 5, ratio: int = 5) -> dict[str, tuple]:
    words = {w: n for w, n in counts.items() if n >= least}
    found = {}
    for w, n in words.items():
        near = [v for v in words if one_edit(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        form = best if best is not None and words[best] >= ratio * n else None
        found[w] = (form, n, len(near), words[form] if form else None)
    out = {}
    for w in found:
        root = w
        while found[root][0] is not None:
            root = found[root][0]
        out[w] = (found[w][0], root, *found[w][1:])
    return out


def as_dict(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_neighbourhoods_are_full_and_distinct():
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(1, 7))) for _ in range(60)]
    words = sorted({"".join(str(ord(c) % spelling.SYMBOLS) for c in w) for w in words})
    symbols = np.array([int(c) for w in words for c in w])
    sizes = np.array([len(w) for w in words])
    owner, keys = spelling.neighbourhood(symbols, sizes)

    def key(text):
        return int(spelling.reduced_keys(np.array([int(c) for c in text], dtype=np.int64), np.array([len(text)]))[0])

    alphabet = [str(i) for i in range(spelling.SYMBOLS)]
    for i, w in enumerate(words):
        full = {w} | {w[:j] + w[j + 1 :] for j in range(len(w))}
        full |= {w[:j] + c + w[j + 1 :] for j in range(len(w)) for c in alphabet}
        full |= {w[:j] + c + w[j:] for j in range(len(w) + 1) for c in alphabet}
        made = keys[owner == i].tolist()
        assert len(made) == len(set(made)) == len(full)
        assert set(made) == {key(x) for x in full}


def test_variants_as_by_hand(spark):
    rnd = random.Random(5)
    base = ["".join(rnd.choice("aeinrstlÃé") for _ in range(rnd.randrange(6, 12))) for _ in range(150)]
    counts: dict[str, int] = {}
    for w in base:
        counts[w] = rnd.choice([3, 5, 40, 400, 3000])
        for _ in range(4):
            j, c = rnd.randrange(len(w)), rnd.choice("aeimÿ")
            counts[rnd.choice([w[:j] + w[j + 1 :], w[:j] + c + w[j + 1 :], w[:j] + c + w[j:]])] = rnd.choice([4, 5, 5, 30, 200])
    long = "ab" * 3000
    counts |= {long: 100, long + "a": 10, long[1:]: 5, "aaaaaa": 9, "aaaaaaa": 9, "aaaaaaaa": 60}
    df = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    assert as_dict(spelling.variants(df)) == by_hand(counts)


def test_chains_lead_to_one_root(spark):
    counts = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "aabbbb": 3125, "abbbbb": 15625, "bbbbbb": 78125}
    got = as_dict(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n bigint")))
    assert {r[1] for r in got.values()} == {"bbbbbb"}
    assert got == by_hand(counts)


def test_tables_as_long_as_the_vocabulary_are_not_broadcast(spark, monkeypatch):
    rnd = random.Random(7)
    counts = {"".join(rnd.choice("aeinrst") for _ in range(6)): rnd.choice([5, 30, 200]) for _ in range(300)}
    plans = []

    def planned(df):
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())

    def noted(df, label, folder=None):
        planned(df)
        return materialize(df, label, folder)

    materialize = spelling.materialize
    monkeypatch.setattr(spelling, "materialize", noted)
    found = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n bigint"))
    planned(found)
    joins = [p for p in plans if "Join" in p]
    assert len(joins) >= 4 and all("SortMergeJoin" in p and "BroadcastHashJoin" not in p for p in joins)
    assert as_dict(found) == by_hand(counts)


def test_counts_garble_by_document(spark, odd_docs, no_docs):
    expected: Counter = Counter()
    for r in odd_docs.collect():
        key = "" if r["doc_id"] is None else r["doc_id"]
        for run in re.findall("[A-Za-zÀ-ÿ]+", r["text"] or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{key}:{run}".encode())
            if h % 3 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                expected[run] += 1
    got = {r["word"]: r["n"] for r in spelling.word_counts(odd_docs, garbled=3).collect()}
    assert got == dict(expected)
    assert spelling.variants(spelling.word_counts(no_docs)).count() == 0
    assert {"word", "thing"} <= set(as_dict(spelling.variants(spelling.word_counts(odd_docs, least_length=4))))


@settings(max_examples=30, deadline=None)
@given(st.text(alphabet="abcà", min_size=1, max_size=9), st.text(alphabet="abcà", min_size=1, max_size=9))
def test_an_edit_is_an_edit_of_the_reduced_word(a, b):
    if a == b or not one_edit(a, b):
        return
    symbols, sizes = spelling.reduce_words([a])
    _, keys = spelling.neighbourhood(symbols, sizes)
    assert int(spelling.reduced_keys(*spelling.reduce_words([b]))[0]) in set(keys.tolist())


def test_query_as_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf_dir}/documents.parquet')")
    rows = con.execute(ORACLES["op11_spelling_variants"]).fetchall()
    got = QUERIES["op11_spelling_variants"](spark, sf_dir).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(rows, key=repr) and rows
