from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from folioguard.llm import tries

SCHEMA = "conv_id long, turn long, role string, text string, key string, size int, path string, n long"
FIELDS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def by_hand(rows):
    """Nodes of the trie by plain dictionaries."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            name = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            own.setdefault(conv, []).append((turn is not None, turn or 0, name, (role, text)))
    own = {c: [t[3] for t in sorted(turns)] for c, turns in own.items()}
    nodes = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        whole = own.get(c - c % 100, [])[:h] + own[c][h:]
        for d in range(len(whole) + 1):
            nodes.setdefault(tuple(whole[:d]), []).append((c, d == len(whole)))
    children, leaves, saved = {}, {}, {}
    for path in sorted(nodes, key=len, reverse=True):
        leaves[path] = leaves.get(path) or 1
        saved[path] = saved.get(path, 0) + ((len(nodes[path]) - 1) * len(path[-1][1]) if path else 0)
        if path:
            up = path[:-1]
            children[up] = children.get(up, 0) + 1
            leaves[up] = leaves.get(up, 0) + leaves[path]
            saved[up] = saved.get(up, 0) + saved[path]
    return sorted(((min(c for c, _ in m), len(p), min(c for c, _ in nodes[p[:-1]]) if p else None, len(m),
                    children.get(p, 0), leaves[p], saved[p],
                    hashlib.sha256(",".join(str(c) for c in sorted(c for c, end in m if end)).encode()).hexdigest())
                   for p, m in nodes.items()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, "p", 2) for r in rows], SCHEMA)


def conversations(seed=1, n=260, words=5, most=9):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(700), n):
        for t in range(rnd.randrange(1, most)):
            rows.append((c, t, rnd.choice(["user", "assistant"][: 1 + t % 2]), "word " * rnd.randrange(words)))
    rnd.shuffle(rows)
    return rows


def result(df):
    return sorted((tuple(r[c] for c in FIELDS) for r in df.collect()), key=repr)


@pytest.mark.parametrize("shard_turns", [1, 7, 60, 100_000])
def test_shards_merge_to_one_trie(spark, shard_turns):
    rows = conversations()
    seq = tries.with_shared_starts(tries.turn_sequences(frame(spark, rows)))
    assert result(tries.prefix_trie(seq, shard_turns)) == by_hand(rows)


def test_deep_and_equal_conversations(spark):
    rows = [(c, t, "u", f"t{t}") for c in (100, 700, 300) for t in range(150)]
    rows += [(700, 150, "u", "more"), (700, 151, "u", "and more")]
    rows += [(c, t, "system", "same") for c in range(2000, 2060) for t in range(3)]
    seq = tries.with_shared_starts(tries.turn_sequences(frame(spark, rows)))
    assert result(tries.prefix_trie(seq, 40)) == by_hand(rows)


def test_many_blocks_of_ids(spark, monkeypatch):
    monkeypatch.setattr(tries, "BLOCK_BITS", 3)
    rows = [(c, 0, "u", "x") for c in range(0, 400, 3)]
    assert result(tries.conversation_trie(frame(spark, rows))) == by_hand(rows)


def test_odd_rows(spark):
    rows = [
        (1, 0, None, None), (1, 0, "", ""), (1, None, "user", "first"), (2, 1, "user", None), (2, 1, "user", None),
        (None, 0, "user", "no conversation"), (5, None, None, "x"), (5, 3, "a", "tie"), (5, 3, "b", "tie"),
        (7, 0, "user", "long " * 50_000), (100, 0, "user", "é🙂"), (103, 0, "user", "gone"), (2**60 + 1, 0, "u", "big id"),
    ]
    assert result(tries.conversation_trie(frame(spark, rows))) == by_hand(rows)
    assert result(tries.conversation_trie(frame(spark, []))) == []
    only_null = [(None, 0, "user", "no conversation")]
    assert result(tries.conversation_trie(frame(spark, only_null))) == []


def test_trees_stay_shallow():
    names = [bytes([i // 256, i % 256]) * 8 for i in range(1000)]
    shard = tries.Shard([(n, [1], 1, i, "") for i, n in enumerate(names)])

    def height(node):
        return 0 if node < 0 else 1 + max(height(shard.low[node]), height(shard.high[node]))

    assert height(shard.child[0]) <= 10
