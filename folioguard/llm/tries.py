"""A prefix trie of conversations from ternary search trees over range shards.

Spark sorts the distinct turn sequences and deals them out in ranges. A task dictionary-encodes the turns of one shard (a
bounded stretch of its range), inserts the sequences median first into a ternary search tree, which keeps it balanced,
and walks it with a stack of its own: members, leaves and savings are added up from the last node to the first. Only
prefixes of a shard's first or last sequence can go on in another shard. These boundary nodes come out as partial sums;
Spark merges them by prefix and adds up their subtrees by pointer doubling, log2(depth) rounds over boundary nodes only.

A sequence is a row of 20 bytes a turn, so one conversation must fit a task. Equal sequences are one row; the ids of their
conversations travel as text in blocks of up to 4 096 ids and are hashed as they stream by. As SHA-256 is sequential,
the ids of one sequence are hashed by one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioguard.llm.common import pick, release
from folioguard.llm.spelling import CRC_TABLE
from folioguard.session import materialize

GROUP = 100
MOST_SHARED = 6
BLOCK_BITS = 12
WIDTH = 16  # bytes of a turn's digest
SHARD_TURNS = 200_000
EMIT_ROWS = 20_000
NOTHING = hashlib.sha256(b"").hexdigest()


def turn_sequences(conversations: DataFrame) -> DataFrame:
    """conv_id and turns, an array of (turn, digest, size) in order of turn, nulls first, for every conversation.

    Null role or text becomes empty. The digest names (role, text), size is the text's code points; turns that tie come in
    order of digest, repeated rows are turns of their own. Rows without a conv_id belong to no conversation. ``shared``
    holds the first turns of the conversation at the start of the hundred, null if there is none.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = pick(conversations, ["conv_id", "turn", "role", "text"]).where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn",
        F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDTH).alias("digest"),
        F.length(text).alias("size")).withColumn("base", F.expr(f"conv_id - conv_id % {GROUP}"))
    own = rows.repartition("base").groupBy("base", "conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "digest", "size"))).alias("turns"))
    first = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("turns", 1, MOST_SHARED - 1)))
    return own.withColumn("shared", first.over(Window.partitionBy("base"))).drop("base")


def with_shared_starts(sequences: DataFrame) -> DataFrame:
    """conv_id and turns: of every conversation the first h turns are those of the one at the start of its hundred (all
    if that has fewer, none if there is no such), h the crc32 of the decimal id modulo six."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(MOST_SHARED)).cast("int")
    return sequences.select("conv_id", F.when(F.col("shared").isNull(), F.slice("turns", h + 1, F.greatest(
        F.size("turns"), F.lit(0)))).otherwise(F.concat(
            F.slice("shared", F.lit(1), h), F.slice("turns", h + 1, F.size("turns")))).alias("turns"))


class Shard:
    """A ternary search tree of turn ids; node 0 is the textless root, ``child`` the root of a node's followers."""

    def __init__(self, sequences: list[tuple]):
        self.sequences = sequences  # (path, sizes, n, least, ends), sorted by path
        self.code: dict[bytes, int] = {}
        self.turn, self.low, self.high, self.child, self.size = [-1], [-1], [-1], [-1], [0]
        self.n, self.least, self.ends = [0], [None], [None]
        turns = sorted({path[i : i + WIDTH] for path, *_ in sequences for i in range(0, len(path), WIDTH)})
        self.code.update(zip(turns, range(len(turns))))
        spans = [(0, len(sequences))]
        while spans:
            start, stop = spans.pop()
            middle = (start + stop) // 2
            self._insert(*sequences[middle])
            if middle + 1 < stop:
                spans.append((middle + 1, stop))
            if start < middle:
                spans.append((start, middle))

    def _follow(self, node: int, turn: int) -> tuple[int, list | None, int]:
        """The follower of ``node`` with this turn, or -1 and the link that should lead to it."""
        links, at = self.child, node
        while (found := links[at]) >= 0 and self.turn[found] != turn:
            links, at = (self.low if turn < self.turn[found] else self.high), found
        return found, links, at

    def _insert(self, path: bytes, sizes: list[int], n: int, least: int, ends: str) -> None:
        node = 0
        for depth, size in enumerate(sizes):
            turn = self.code[path[depth * WIDTH : depth * WIDTH + WIDTH]]
            found, links, at = self._follow(node, turn)
            if found < 0:
                found = links[at] = len(self.turn)
                for column, value in zip((self.turn, self.low, self.high, self.child, self.size, self.n, self.least, self.ends),
                                         (turn, -1, -1, -1, size, 0, None, None)):
                    column.append(value)
            node = found
        self.n[node], self.least[node], self.ends[node] = n, least, ends

    def _boundary(self) -> dict[int, bytes]:
        """Nodes that other shards may share, with the names of their prefixes."""
        named = {}
        for path, *_ in (self.sequences[0], self.sequences[-1]):
            node, name = 0, hashlib.sha256()
            named[0] = name.digest()[:WIDTH]
            for at in range(0, len(path), WIDTH):
                node = self._follow(node, self.code[path[at : at + WIDTH]])[0]
                name.update(path[at : at + WIDTH])
                named[node] = name.digest()[:WIDTH]
        return named

    def rows(self) -> Iterator[tuple]:
        """A tuple in order of ``NODE_KINDS`` for every node."""
        order, depth, parent = [], [0] * len(self.turn), [-1] * len(self.turn)
        stack = [0]
        while stack:
            node = stack.pop()
            order.append(node)
            for link in (self.low[node], self.high[node]):
                if link >= 0:
                    depth[link], parent[link] = depth[node], parent[node]
                    stack.append(link)
            if (link := self.child[node]) >= 0:
                depth[link], parent[link] = depth[node] + 1, node
                stack.append(link)
        named = self._boundary()
        children, leaves, saved = ([0] * len(self.turn) for _ in range(3))
        for node in reversed(order):  # a node's followers come after it
            if node not in named:
                leaves[node] = leaves[node] or 1
                saved[node] += (self.n[node] - 1) * self.size[node]
            up = parent[node]
            if up < 0:
                continue
            self.n[up] += self.n[node]
            self.least[up] = self.least[node] if self.least[up] is None else min(self.least[up], self.least[node])
            if node not in named:
                children[up] += 1
                leaves[up] += leaves[node]
                saved[up] += saved[node]
        for node in order:
            up = parent[node]
            yield (named.get(node), named.get(up), self.least[node], depth[node],
                   None if up < 0 or up in named else self.least[up], self.n[node], children[node], leaves[node],
                   saved[node], self.size[node], self.ends[node])


NODE_KINDS = {"key": pa.binary(), "up": pa.binary(), **{c: pa.int64() for c in (
    "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "size")},
    "ends_sha256": pa.string()}
NODE_FIELDS = ("key binary, up binary, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, "
               "n_children bigint, n_leaves bigint, saved_tokens bigint, size bigint, ends_sha256 string")
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def _shard_nodes(blocks: DataFrame, shard_turns: int) -> DataFrame:
    """Nodes of all shards: complete ones have no key, boundary nodes have their key and what their complete followers in
    this shard add up to. ``up`` is the key of a parent on the boundary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()

        def emit(sequences: list[tuple]) -> Iterator[pa.RecordBatch]:
            out: list[tuple] = []
            for row in Shard(sequences).rows():
                out.append(row)
                if len(out) == EMIT_ROWS:
                    yield batch_of(out)
                    out = []
            if out:
                yield batch_of(out)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, type=t) for c, t in zip(zip(*rows), NODE_KINDS.values())], names=list(NODE_KINDS))

        waiting: list[tuple] = []
        turns = 0
        path = digest = None
        sizes: list[int] = []
        n = least = 0
        for batch in batches:
            for row in batch.to_pylist():
                if row["path"] != path:
                    if path is not None:
                        waiting.append((path, sizes, n, least, digest.hexdigest()))
                        turns += len(sizes) + 1
                        if turns >= shard_turns:
                            yield from emit(waiting)
                            waiting, turns = [], 0
                    path, sizes, n, least = row["path"], row["sizes"], 0, row["least"]
                    digest = hashlib.sha256()
                elif n:
                    digest.update(b",")
                n, least = n + row["n"], min(least, row["least"])
                digest.update(row["ids"].encode())
        if path is not None:
            waiting.append((path, sizes, n, least, digest.hexdigest()))
            yield from emit(waiting)

    return blocks.repartitionByRange("path").sortWithinPartitions("path", "block").mapInArrow(run, NODE_FIELDS)


def _merged(nodes: DataFrame) -> DataFrame:
    """Boundary nodes with the sums of their whole subtrees: key, up and ``COLUMNS``."""
    edge = materialize(nodes.where("key is not null").groupBy("key").agg(
        F.max("up").alias("up"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.max("size").alias("size"),
        F.max("ends_sha256").alias("ends_sha256")), "boundary")
    below = edge.where("up is not null").groupBy(F.col("up").alias("of")).agg(F.count(F.lit(1)).alias("more"))
    edge = materialize(edge.join(below, F.col("key") == F.col("of"), "left").withColumn(
        "n_children", F.col("n_children") + F.coalesce("more", F.lit(0))).select(
        "key", "up", "conv_id", "depth", "n_convs", "n_children",
        (F.col("n_leaves") + (F.col("n_children") == 0).cast("bigint")).alias("n_leaves"),
        (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("size")).alias("saved_tokens"), "ends_sha256"), "boundary")
    sums = edge.select("key", "up", "n_leaves", "saved_tokens")
    while sums.where("up is not null").limit(1).count():  # ``up`` is twice as far away after each round
        gained = sums.where("up is not null").groupBy(F.col("up").alias("of")).agg(
            F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
        further = sums.select(F.col("key").alias("at"), F.col("up").alias("next"))
        sums = materialize(sums.join(gained, F.col("key") == F.col("of"), "left").join(
            further, F.col("up") == F.col("at"), "left").select(
            "key", F.col("next").alias("up"), (F.col("n_leaves") + F.coalesce("l", F.lit(0))).alias("n_leaves"),
            (F.col("saved_tokens") + F.coalesce("s", F.lit(0))).alias("saved_tokens")), "subtrees")
    parents = edge.select(F.col("key").alias("of"), F.col("conv_id").alias("parent_conv_id"))
    return edge.drop("n_leaves", "saved_tokens").join(sums.drop("up"), "key").join(
        parents, F.col("up") == F.col("of"), "left").drop("of")


def prefix_trie(sequences: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row for each distinct prefix of the sequences (conv_id, turns with digest and size), the empty one included.

    conv_id (the smallest member), depth, parent_conv_id (of the parent, null for the root), n_convs, n_children, n_leaves
    (childless nodes below or at it), saved_tokens (over the subtree, each node's members but one times the code points
    of its last text) and ends_sha256 (of the comma-joined sorted ids that end there). conv_ids are distinct. Conversations
    without turns are members of the root; an empty table has no nodes.
    """
    paths = sequences.select(
        "conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("path"),
        F.transform("turns", lambda t: t["size"]).alias("sizes"), F.shiftright("conv_id", BLOCK_BITS).alias("block"))
    blocks = materialize(paths.groupBy("path", "block").agg(
        F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"), F.first("sizes").alias("sizes"),
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids")),
        "sequences")
    nodes = materialize(_shard_nodes(blocks, shard_turns), "nodes")
    merged = materialize(_merged(nodes), "merged")
    done = nodes.where("key is null and up is null").select(*COLUMNS)
    tops = nodes.where("key is null and up is not null").drop("parent_conv_id").join(
        merged.select(F.col("key").alias("of"), F.col("conv_id").alias("parent_conv_id")), F.col("up") == F.col("of"))
    out = done.unionByName(tops.select(*COLUMNS)).unionByName(merged.select(*COLUMNS))
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING)))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The prefix trie of the conversations with shared starts; see ``turn_sequences`` for nulls, ties and repeated rows."""
    return prefix_trie(with_shared_starts(turn_sequences(conversations)))


ORACLE = f"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT {CRC_TABLE} AS steps),
named AS (
    SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS name,
        length(coalesce(text, '')) AS size
    FROM conversations WHERE conv_id IS NOT NULL),
own AS MATERIALIZED (
    SELECT conv_id, list(name ORDER BY turn NULLS FIRST, name) AS names, list(size ORDER BY turn NULLS FIRST, name) AS sizes
    FROM named GROUP BY conv_id),
shifted AS (
    SELECT conv_id, names, sizes, (xor(4294967295::UBIGINT, list_reduce([4294967295::UBIGINT] || list_transform(
        string_split(conv_id::VARCHAR, ''), lambda c: ord(c)::UBIGINT),
        lambda c, b: xor(steps[(xor(c, b) % 256)::BIGINT + 1], c // 256))) % 6)::BIGINT AS h
    FROM own, crc),
rebuilt AS (
    SELECT s.conv_id, coalesce(b.names[:h], []) || s.names[h + 1:] AS names, coalesce(b.sizes[:h], []) || s.sizes[h + 1:] AS sizes
    FROM shifted s LEFT JOIN own b ON b.conv_id = s.conv_id - s.conv_id % 100),
prefixes AS (
    SELECT conv_id, len(names) AS n, unnest(range(0, len(names) + 1)) AS d, array_to_string(names, '') AS whole, sizes
    FROM rebuilt),
nodes AS MATERIALIZED (
    SELECT d AS depth, whole[:64 * d] AS path, min(conv_id) AS conv_id, count(*) AS n_convs,
        any_value(CASE WHEN d > 0 THEN sizes[d] ELSE 0 END) AS size,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256
    FROM prefixes GROUP BY ALL),
children AS MATERIALIZED (
    SELECT depth - 1 AS depth, path[:64 * (depth - 1)] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
valued AS (
    SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (depth, path)),
lifted AS (
    SELECT unnest(range(0, depth + 1)) AS d, path, n_children, (n_convs - 1) * size AS own FROM valued),
sums AS (
    SELECT d AS depth, path[:64 * d] AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum(own)::BIGINT AS saved_tokens
    FROM lifted GROUP BY ALL)
SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens, v.ends_sha256
FROM valued v JOIN sums USING (depth, path) LEFT JOIN nodes p ON p.depth = v.depth - 1 AND p.path = v.path[:64 * (v.depth - 1)]
"""
