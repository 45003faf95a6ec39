"""SimHash near-duplicates through a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most three bits agree in at least five of their eight bytes. Postings by a
single byte would each hold a 256th of the corpus, so the index posts fingerprints under four byte positions and their
bytes at once: the fourteen sets of four positions whose numbers cancel under exclusive or. Three positions determine
the fourth such one, so any three differing bytes leave exactly one of these sets untouched; every pair that reaches
the guaranteed five matches meets in a posting, and postings hold about N / 2**32 strangers. Four or five bits leave
four or three bytes alike; then all sets of so many positions are posted.

Inside a posting the shared positional bytes of a pair are tallied, pairs below the guaranteed minimum are left, the
rest is verified by counting differing bits. Of the verified links a posting gives a spanning forest, so a group of many near copies costs
links in proportion to its members, not to its pairs. Equal fingerprints are one node throughout.

Few bits do not say how many shingles two texts share: at a similarity of 0.8 some ten bits of 64 differ.
``first_of_similar`` therefore takes the neighbours above as one candidate search among several. The others are
min-wise postings over the sets of shingles, of which a pair at 0.8 meets in one at least with a probability above
0.9999. Within every posting the links are verified by the exact Jaccard similarity before components are formed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioguard.llm.common import per_text, release, set_aside
from folioguard.llm.components import components
from folioguard.session import discard, materialize, staging_path

SEED = 42
POSITIONS = 8
HASHES_AT_ONCE = 1 << 15
LOOK_UP_FROM = 20_000
BANDS, MINIMA = 24, 5  # 1 - (1 - 0.8**5)**24 is 0.99993
FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MINIMA_AT_ONCE = 1 << 12


def posting_sets(max_bits: int) -> list[tuple[int, ...]]:
    """Position sets of which any two fingerprints within ``max_bits`` bits agree on at least one."""
    if not 1 <= max_bits <= 5:
        raise ValueError("fingerprints may differ in 1 to 5 bits")
    if max_bits <= 3:
        return [s for s in combinations(range(POSITIONS), 4) if s[0] ^ s[1] ^ s[2] ^ s[3] == 0]
    return list(combinations(range(POSITIONS), POSITIONS - max_bits))


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """A 64-bit hash of each word shingle of the text in order, repeats included.

    A-Z are lower-cased, words end at ASCII white space. Fewer words than a shingle are one shingle; no word gives none.
    """
    words = text.encode("utf-8").lower().split()
    if not words:
        return np.zeros(0, dtype="<u8")
    joined = b" ".join(words)
    width = min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - width + 1]
    spans = zip(starts.tolist(), ends[width - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in spans], dtype="<u8")


def _majority(hashes: np.ndarray) -> int:
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), HASHES_AT_ONCE):
        some = hashes[at : at + HASHES_AT_ONCE].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprint(text: str, shingle: int) -> int:
    """64 bits, each set if it is in more than half of the hashes of the text's word shingles; no word gives zero."""
    return _majority(shingle_hashes(text, shingle))


def min_postings(distinct: np.ndarray) -> list[int]:
    """One key a band for a set of hashes: a digest of its smallest elements under the band's permutations."""
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(distinct), MINIMA_AT_ONCE):
        np.minimum(least, (FACTORS[:, None] * distinct[at : at + MINIMA_AT_ONCE]).min(axis=1), out=least)
    return [xxhash.xxh64_intdigest(band.tobytes(), i) for i, band in enumerate(least.reshape(BANDS, MINIMA))]


def fingerprints(docs: DataFrame, shingle: int, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``fp``, the fingerprint as a signed 64-bit integer. Null and empty texts have zero."""

    def prepare():
        release()

        def work(texts: list[str]) -> dict:
            return {"fp": np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64)}

        return work

    return per_text(docs, keep, prepare, "fp bigint")


def forest(values: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among the distinct ``values`` of one posting, each link verified.

    Every value is compared once with those not yet reached. In a large posting its possible partners are looked up
    instead, where there are fewer ways to change the bits that the posting leaves open than there are values.
    """
    values = np.sort(values)
    left, a, b = values, [], []
    flips = None
    if len(values) > LOOK_UP_FROM:
        open_bits = np.array([1 << i for i in range(64)], dtype=np.uint64)
        common = np.bitwise_and.reduce(values) | ~np.bitwise_or.reduce(values)
        open_bits = open_bits[(open_bits & common) == 0]
        if sum(comb(len(open_bits), k) for k in range(1, max_bits + 1)) < len(values):
            flips = np.array([np.bitwise_or.reduce(np.array(c, dtype=np.uint64))
                              for k in range(1, max_bits + 1) for c in combinations(open_bits, k)], dtype=np.uint64)
    reached = np.zeros(len(values), dtype=bool)
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue:
            at = queue.pop()
            if flips is None:
                diff = left ^ at
                shared = (diff.view(np.uint8).reshape(-1, POSITIONS) == 0).sum(axis=1)
                near = np.flatnonzero(shared >= POSITIONS - max_bits)
                near = near[np.bitwise_count(diff[near]) <= max_bits]
                found, left = left[near], np.delete(left, near)
            else:
                reached[np.searchsorted(values, at)] = True
                maybe = np.bitwise_xor(flips, at)
                place = np.minimum(np.searchsorted(values, maybe), len(values) - 1)
                hit = np.unique(place[(values[place] == maybe) & ~reached[place]])
                reached[hit] = True
                found = values[hit]
            a += [at] * len(found)
            b += found.tolist()
            queue += found.tolist()
        if flips is not None:
            left = left[~reached[np.searchsorted(values, left)]]
    return np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64)


def _posting_links(batches: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    """Links within each posting of a sorted partition; a posting may run over batches."""
    release()
    keys, values = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)

    def links(keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(new, len(keys)))
        pair = new[sizes == 2]
        diff = values[pair] ^ values[pair + 1]
        near = pair[np.bitwise_count(diff) <= max_bits]
        a, b = [values[near]], [values[near + 1]]
        for at, size in zip(new[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            x, y = forest(values[at : at + size], max_bits)
            a.append(x)
            b.append(y)
        return pa.RecordBatch.from_pydict(
            {"a": np.concatenate(a).view(np.int64), "b": np.concatenate(b).view(np.int64)})

    held = [(keys, values)]
    for batch in batches:
        k = batch.column("posting").to_numpy()
        v = batch.column("fp").to_numpy().view(np.uint64)
        held.append((k, v))
        if len(k) and k[0] == k[-1] and all(len(h[0]) == 0 or h[0][-1] == k[0] for h in held[:1]):
            continue  # one posting so far
        keys, values = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        last = int(np.searchsorted(keys, keys[-1], side="left")) if len(keys) else 0
        if last:
            yield links(keys[:last], values[:last])
        held = [(keys[last:], values[last:])]
    keys, values = (np.concatenate([h[i] for h in held]) for i in (0, 1))
    if len(keys):
        yield links(keys, values)


def links(prints: DataFrame, max_bits: int = 3) -> DataFrame:
    """a and b: links between different fingerprints that differ in at most ``max_bits`` bits, enough of them to
    connect whatever such links connect. ``prints`` has distinct fingerprints in ``fp``."""

    def posting(number: int, positions: tuple[int, ...]):
        key = F.lit(number).cast("bigint")
        for p in positions:
            key = F.shiftleft(key, 8).bitwiseOR(F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255)))
        return key

    posted = prints.select(
        F.explode(F.array(*[posting(i, s) for i, s in enumerate(posting_sets(max_bits))])).alias("posting"), "fp")
    return posted.repartition("posting").sortWithinPartitions("posting").mapInArrow(
        lambda batches: _posting_links(batches, max_bits), "a bigint, b bigint")


def _roots(marked: DataFrame, max_bits: int) -> DataFrame:
    """print, first and root: each distinct fingerprint of ``marked`` (fp, doc_id), its smallest doc_id and the smallest
    fingerprint that links reach."""
    nodes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    roots = components(links(nodes.select("fp"), max_bits))
    return nodes.join(roots, F.col("fp") == F.col("node"), "left").select(
        F.col("fp").alias("print"), "first", F.coalesce("root", "fp").alias("root"))


def groups(docs: DataFrame, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """doc_id, ``fp`` and ``component_id``, the smallest doc_id that links reach, for every document.

    Documents with equal fingerprints are linked, those without words among them. Null ids belong to a component as
    others do; it has the null id only if no member has another. Repeated rows stay. An empty table gives no rows.
    """
    marked = materialize(fingerprints(docs, shingle), "fingerprints")
    named = _roots(marked, max_bits)
    least = named.groupBy("root").agg(F.min("first").alias("component_id")).withColumnRenamed("root", "of_root")
    labels = named.join(least, F.col("root") == F.col("of_root")).select("print", "component_id")
    return marked.join(labels, F.col("fp") == F.col("print")).drop("print")


def first_of_groups(docs: DataFrame, shingle: int, max_bits: int) -> DataFrame:
    """One row of ``docs`` (doc_id, text and any others) for each component: that with the smallest doc_id.

    Of rows that share it, one is kept; a row without an id only if its component has no other.
    """
    plain, restored = set_aside(docs)
    marked = materialize(fingerprints(plain, shingle, tuple(plain.columns)).withColumn(
        "__row", F.monotonically_increasing_id()), "fingerprints")  # written, so the numbers stand
    narrow = marked.select("fp", "doc_id", "__row")
    rows = narrow.join(_roots(narrow, max_bits).select("print", "root"), F.col("fp") == F.col("print"))
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__row")).alias("one"))
    return restored(marked.join(
        first.select(F.col("one.__row").alias("__kept")), F.col("__row") == F.col("__kept"), "left_semi"))


def _marks(texts: list[str], shingle: int) -> dict:
    prints, nodes, bands = [], [], []
    for text in texts:
        hashes = shingle_hashes(text, shingle)
        distinct = np.unique(hashes)
        prints.append(_majority(hashes))
        nodes.append(xxhash.xxh64_intdigest(distinct.tobytes(), SEED))
        bands.append(min_postings(distinct))
    return {"fp": np.array(prints, dtype=np.uint64).view(np.int64), "node": np.array(nodes, dtype=np.uint64).view(np.int64),
            "bands": list(np.array(bands, dtype=np.uint64).reshape(-1, BANDS).view(np.int64))}


def similar_forest(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Places of a spanning forest of the links among sorted sets of distinct hashes, each link of a Jaccard similarity
    of at least ``least``. Every set is compared once with those not yet reached."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    known, ids = np.unique(np.concatenate(sets), return_inverse=True)
    ids = np.split(ids, np.cumsum(sizes)[:-1])
    marks = np.zeros(len(known), dtype=np.int8)
    left, out, flat, ends = np.arange(len(sets)), [], None, None
    while len(left):
        queue, left, flat = [int(left[0])], left[1:], None
        while queue and len(left):
            at = queue.pop()
            if flat is None:
                flat = np.concatenate([ids[i] for i in left])
                ends = np.cumsum(sizes[left])
            marks[ids[at]] = 1
            totals = np.concatenate([[0], np.cumsum(marks[flat], dtype=np.int64)])
            marks[ids[at]] = 0
            shared = totals[ends] - totals[ends - sizes[left]]
            near = shared / np.maximum(sizes[left] + sizes[at] - shared, 1) >= least
            if near.any():
                found, left, flat = left[near].tolist(), left[~near], None
                out += [(at, i) for i in found]
                queue += found
    return out


def _similar_links(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Verified links within each posting of a sorted partition; the sets of one posting are held at a time."""
    release()
    posting, nodes, sets, a, b = None, [], [], [], []

    def close() -> None:
        if len(nodes) > 1:
            for i, j in similar_forest(sets, least):
                a.append(nodes[i])
                b.append(nodes[j])
        nodes.clear()
        sets.clear()

    for batch in batches:
        for key, node, content in zip(
                batch.column("posting").to_pylist(), batch.column("node").to_pylist(), batch.column("shingles").to_pylist()):
            if key != posting:
                close()
                posting = key
            nodes.append(node)
            sets.append(np.frombuffer(content, dtype="<u8"))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        a.clear()
        b.clear()
    close()
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def similar_links(
    marked: DataFrame, nodes: DataFrame, shingle: int, max_bits: int, least: float, folder: str | None = None,
) -> DataFrame:
    """a and b: links between different sets of shingles of a Jaccard similarity of at least ``least``, enough of them
    to connect whatever such links within a posting connect.

    ``marked`` has text, fp, node and __row of every document, ``nodes`` has node, bands and __first, the __row of one
    document, for every distinct set. A posting is a group of SimHash neighbours or a min-wise band. Postings with the
    same members are verified once, and sets are made again only of texts that share a posting with another. The result
    reads tables in ``folder``.
    """
    prints = materialize(marked.select("fp", "node").distinct(), "prints", folder)
    roots = components(links(prints.select("fp").distinct(), max_bits), folder)
    neighbours = prints.join(roots.withColumnRenamed("node", "__of"), F.col("fp") == F.col("__of"), "left").select(
        F.xxhash64(F.coalesce("root", "fp")).alias("posting"), "node").distinct()
    posted = materialize(nodes.select(F.explode("bands").alias("posting"), "node").union(neighbours), "postings", folder)
    members = posted.groupBy("posting").agg(
        F.count(F.lit(1)).alias("n"), F.min("node").alias("low"), F.max("node").alias("high"),
        F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum")).where("low < high")
    once = members.groupBy("n", "low", "high", "sum").agg(F.min("posting").alias("__once")).select("__once")
    shared = materialize(posted.join(once, F.col("posting") == F.col("__once"), "left_semi"), "shared-postings", folder)
    met = shared.select(F.col("node").alias("__met")).distinct()
    rows = nodes.join(met, F.col("node") == F.col("__met"), "left_semi").select("__first")
    texts = marked.select("text", "node", "__row").join(rows, F.col("__row") == F.col("__first"), "left_semi")

    def prepare():
        release()
        return lambda texts: {"shingles": [np.unique(shingle_hashes(t, shingle)).tobytes() for t in texts]}

    sets = per_text(texts, ("node",), prepare, "shingles binary").withColumnRenamed("node", "__of")
    return shared.join(sets, F.col("node") == F.col("__of")).select("posting", "node", "shingles").repartition(
        "posting").sortWithinPartitions("posting").mapInArrow(
        lambda batches: _similar_links(batches, least), "a bigint, b bigint")


def first_of_similar(docs: DataFrame, shingle: int, max_bits: int, least: float) -> DataFrame:
    """One row of ``docs`` (doc_id, text and any others) for each component of texts whose sets of word shingles have a
    Jaccard similarity of at least ``least``: that with the smallest doc_id.

    Shingles are compared by 64-bit hashes. Of rows that share an id, one is kept; a row without an id only if its
    component has no other. Texts without words are alike. All staged tables but the marked rows and the numbers of
    those that stay are gone before the rows are picked.
    """
    plain, restored = set_aside(docs)
    folder = staging_path(docs.sparkSession, "similar")

    def prepare():
        release()
        return lambda texts: _marks(texts, shingle)

    marked = materialize(per_text(
        plain, tuple(plain.columns), prepare, "fp bigint, node bigint, bands array<bigint>").withColumn(
        "__row", F.monotonically_increasing_id()), "fingerprints")  # written, so the numbers stand
    nodes = materialize(marked.groupBy("node").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__row")).alias("one"),
        F.any_value("bands").alias("bands")).withColumn("__first", F.col("one.__row")), "distinct-sets", folder)
    roots = components(similar_links(marked, nodes, shingle, max_bits, least, folder), folder).withColumnRenamed("node", "__of")
    first = nodes.select("node", "one").join(roots, F.col("node") == F.col("__of"), "left").groupBy(
        F.coalesce("root", "node")).agg(F.min("one").alias("one"))
    kept = materialize(first.select(F.col("one.__row").alias("__kept")), "kept-rows")
    discard(docs.sparkSession, folder)
    return restored(marked.join(kept, F.col("__row") == F.col("__kept"), "left_semi"))
