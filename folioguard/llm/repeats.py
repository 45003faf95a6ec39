"""Removing repeated byte strings by distributed prefix doubling over sampled positions.

A byte goes if a string of ``min_len`` bytes that covers it also starts somewhere else. Ranking every byte position
would shuffle many times the input in each round, so positions are sampled by content: of the ``k``-byte prefixes inside
each window of ``min_len`` bytes the one with the smallest hash is its position. The choice depends on the window's bytes
alone, so equal windows choose the same place, and a document has about ``2 / (min_len - k)`` positions a byte, each
standing for a run of windows.

Rounds. Spark groups positions by name, drops unique ones, sorts the rest and numbers them: that is their rank.
1. The name is the ``k``-byte string at the position.
2. The pair (rank, name of all bytes under the position's windows). Past the threshold already: where a pair is met
   twice, all windows of the run are repeated. A pair met once goes on if other pairs share its rank; of a repeated
   pair one member goes on, as something to compare with.
3. The pair (rank, name of the bytes that a block of neighbouring windows has in common), a longer string around the
   position at a known offset. Unique ones are dropped, and blocks whose windows all agree with another's are done.
4. What is left, runs at whose edges repeats begin and end, is compared window by window inside its rank, by a 128-bit
   hash. A rank with more members than ``LOCAL_MEMBERS`` is not gathered: its windows are counted by Spark.

Equal texts have one name (their SHA-256) throughout and are settled alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioguard.llm.common import release, small_batches
from folioguard.session import discard, materialize, staging_path

MIN_LEN = 400
PASSAGE = (200, 51)  # bytes and whole words of a passage of over 50 words
CHUNK = 1 << 16
LOCAL_MEMBERS = 20_000
DOC = ("d1", "d2")
GOLD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Lengths:
    """Window length, prefix length at a position, and windows a block in the third round."""

    min_len: int = MIN_LEN

    @property
    def k(self) -> int:
        return max(1, self.min_len // 4)

    @property
    def span(self) -> int:
        return self.min_len - self.k + 1

    @property
    def block(self) -> int:
        return max(1, -(-self.span // 5))


class RollingHash:
    """Polynomial hash of any substring of a chunk, modulo 2**64."""

    def __init__(self, seed: int, size: int):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        base = int(rng.integers(1 << 40, 1 << 62)) * 4 + 3
        powers = np.full(size + 1, base, dtype=np.uint64)
        powers[0] = 1
        self.powers = np.multiply.accumulate(powers)
        powers[1:] = pow(base, -1, 1 << 64)
        self.inverse = np.multiply.accumulate(powers)

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.table[data] * self.powers[: len(data)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return scramble((sums[end] - sums[start]) * self.inverse[start])


def scramble(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    return x * np.uint64(0xFF51AFD7ED558CCD)


@lru_cache(maxsize=4)
def hashes(min_len: int) -> tuple[RollingHash, RollingHash]:
    return RollingHash(1, CHUNK + min_len), RollingHash(2, CHUNK + min_len)


def positions(data: np.ndarray, lengths: Lengths) -> Iterator[tuple[np.ndarray, ...]]:
    """For each run of windows with one position: name of its prefix, name of all its bytes, first window, distance
    from there to the position, and number of windows less one. Long texts go chunk by chunk."""
    first, second = hashes(lengths.min_len)
    k, span, low = lengths.k, lengths.span, np.uint64(20)
    for at in range(0, len(data) - lengths.min_len + 1, CHUNK):
        part = data[at : at + CHUNK + lengths.min_len - 1]
        sums = first.sums(part)
        starts = np.arange(len(part) - k + 1)
        names = first.of(sums, starts, starts + k)
        least, width = (names >> low << low) | starts.astype(np.uint64), 1
        while width * 2 <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        place = (least & np.uint64((1 << 20) - 1)).astype(np.int64)
        cut = np.flatnonzero(place[1:] != place[:-1]) + 1
        lo = np.concatenate([[0], cut])
        more = np.append(cut, len(place)) - 1 - lo
        place = place[lo]
        whole = second.of(second.sums(part), lo, lo + more + lengths.min_len)
        whole = scramble(whole + (place - lo).astype(np.uint64) * GOLD)
        yield names[place].view(np.int64), whole.view(np.int64), lo + at, place - lo, more


def _batch(columns: dict[str, np.ndarray | list], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[c], type=t) for c, t in kinds.items()], names=list(kinds))


POSITION_KINDS = {"k": pa.int64(), "u": pa.int64(), "d1": pa.int64(), "d2": pa.int64(), "lo": pa.int64(),
                  "to_place": pa.int32(), "more": pa.int32()}
POSITION_FIELDS = "k bigint, u bigint, d1 bigint, d2 bigint, lo bigint, to_place int, more int"


def sample_positions(texts: DataFrame, lengths: Lengths) -> DataFrame:
    """Positions of ``texts`` (digest, data); texts shorter than a window have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            held: list[tuple] = []
            size = 0
            for digest, data in zip(batch.column("digest"), batch.column("data")):
                raw = np.frombuffer(data.as_buffer(), dtype=np.uint8) if data.is_valid and len(data.as_buffer()) else ()
                name = np.frombuffer(digest.as_py()[:16], dtype="<i8")
                for part in positions(raw, lengths) if len(raw) >= lengths.min_len else ():
                    n = len(part[0])
                    held.append((part[0], part[1], np.full(n, name[0]), np.full(n, name[1]), *part[2:]))
                    size += n
                if size > 100_000:
                    yield _batch(dict(zip(POSITION_KINDS, map(np.concatenate, zip(*held)))), POSITION_KINDS)
                    held, size = [], 0
            if held:
                yield _batch(dict(zip(POSITION_KINDS, map(np.concatenate, zip(*held)))), POSITION_KINDS)

    return texts.select("digest", "data").mapInArrow(run, POSITION_FIELDS)


def ranked(classes: DataFrame, *keys: str) -> DataFrame:
    """``rank_of_sorted`` of distinct keys: grows in their sort order. Ranges are sorted apart, so no task sees all."""
    return classes.repartitionByRange(*[F.col(c) for c in keys]).sortWithinPartitions(*keys).withColumn(
        "rank_of_sorted", F.monotonically_increasing_id())


CONTEXT_KINDS = {"rank": pa.int64(), "d1": pa.int64(), "d2": pa.int64(), "lo": pa.int64(), "to_place": pa.int32(),
                 "more": pa.int32(), "known": pa.bool_(), "context": pa.binary()}
CONTEXT_FIELDS = ("rank bigint, d1 bigint, d2 bigint, lo bigint, to_place int, more int, known boolean, "
                  "context binary")


def contexts(wanted: DataFrame, blobs: DataFrame, lengths: Lengths) -> DataFrame:
    """The bytes under each wanted run of windows, from the texts that hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out: dict[str, list] = {c: [] for c in CONTEXT_KINDS}
            for i, blob in enumerate(batch.column("packed")):
                data = unpack.decompress(blob.as_py())
                for r in batch.column("runs")[i].as_py():
                    own = r | {"d1": batch.column("d1")[i].as_py(), "d2": batch.column("d2")[i].as_py(),
                               "context": data[r["lo"] : r["lo"] + r["more"] + lengths.min_len]}
                    for c in CONTEXT_KINDS:
                        out[c].append(own[c])
                if len(out["lo"]) > 20_000:
                    yield _batch(out, CONTEXT_KINDS)
                    out = {c: [] for c in CONTEXT_KINDS}
            yield _batch(out, CONTEXT_KINDS)

    asked = wanted.groupBy(*DOC).agg(F.collect_list(F.struct("rank", "lo", "to_place", "more", "known")).alias("runs"))
    one = blobs.groupBy(*DOC).agg(F.first("packed").alias("packed"))  # of equal texts
    return asked.join(one, list(DOC)).select(*DOC, "packed", "runs").mapInArrow(run, CONTEXT_FIELDS)


RUN = ("rank", "d1", "d2", "lo", "to_place", "more", "known")
BLOCK_KINDS = {c: CONTEXT_KINDS[c] for c in RUN} | {"block": pa.int32()} | {
    c: pa.int64() for c in ("common", "common2", "whole", "whole2")}
BLOCK_FIELDS = CONTEXT_FIELDS.replace("context binary", "block int, common bigint, common2 bigint, whole bigint, "
                                      "whole2 bigint")


def blocks(found: DataFrame, lengths: Lengths) -> DataFrame:
    """For each block of neighbouring windows in a run: the name of the bytes they share and of all their bytes.

    A window's offset is its distance to the position; blocks are aligned by offset, so that equal windows fall into
    blocks of one number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        size, need = lengths.block, lengths.min_len
        name = xxhash.xxh3_128_digest
        for batch in batches:
            rows = batch.to_pydict()
            out: dict[str, list] = {c: [] for c in BLOCK_KINDS}
            names: list[bytes] = []
            for i, context in enumerate(rows["context"]):
                far = rows["to_place"][i]  # offset of the first window
                near = far - rows["more"][i]
                for b in range(near // size, far // size + 1):
                    least, most = b * size, b * size + size - 1
                    names.append(name(context[far - least : far - most + need]))
                    names.append(name(context[far - min(far, most) : far - max(near, least) + need]))
                    out["block"].append(b)
                    for c in RUN:
                        out[c].append(rows[c][i])
            pairs = np.frombuffer(b"".join(names), dtype="<i8").reshape(-1, 4)
            for j, c in enumerate(("common", "common2", "whole", "whole2")):
                out[c] = pairs[:, j]
            yield _batch(out, BLOCK_KINDS)

    return found.mapInArrow(run, BLOCK_FIELDS)


SPAN_KINDS = {"d1": pa.int64(), "d2": pa.int64(), "start": pa.int64(), "end": pa.int64()}
SPAN_FIELDS = "d1 bigint, d2 bigint, start bigint, end bigint"


def _windows(row: dict, need: int, size: int) -> Iterator[tuple[int, int, bytes]]:
    """Offset, start in the text and bytes of each window of a run that lies in the row's block."""
    far, lo = row["to_place"], row["lo"]
    top, least = min(far, row["block"] * size + size - 1), max(far - row["more"], row["block"] * size)
    for offset in range(top, least - 1, -1):
        yield offset, lo + far - offset, row["context"][far - offset : far - offset + need]


def _compare(batches: Iterator[pa.RecordBatch], lengths: Lengths) -> Iterator[pa.RecordBatch]:
    """Repeated stretches of the members of each rank, in partitions sorted by rank."""
    release()
    need, size = lengths.min_len, lengths.block

    def settle(members: list[dict], out: list[tuple]) -> None:
        seen: dict[tuple[int, bytes], int] = {}
        marks = []
        for row in members:
            own = [((o, xxhash.xxh3_128_digest(w)), p) for o, p, w in _windows(row, need, size)]
            for mark, _ in own:
                seen[mark] = seen.get(mark, 0) + 1
            if not row["known"]:
                marks.append((row, own))
        for row, own in marks:
            start = before = None
            for mark, p in own:
                if seen[mark] < 2:
                    continue
                if before is None or p != before + 1:
                    if before is not None:
                        out.append((row["d1"], row["d2"], start, before + need))
                    start = p
                before = p
            if before is not None:
                out.append((row["d1"], row["d2"], start, before + need))

    held: list[dict] = []
    for batch in batches:
        out: list[tuple] = []
        for row in batch.to_pylist():
            if held and row["rank2"] != held[0]["rank2"]:
                settle(held, out)
                held = []
            held.append(row)
        if out:
            yield _batch(dict(zip(SPAN_KINDS, zip(*out))), SPAN_KINDS)
    out = []
    settle(held, out)
    if out:
        yield _batch(dict(zip(SPAN_KINDS, zip(*out))), SPAN_KINDS)


def _count_windows(crowded: DataFrame, lengths: Lengths, folder: str) -> DataFrame:
    """The same for ranks with very many members: a row for each window, counted by Spark."""
    need, size = lengths.min_len, lengths.block
    kinds = {"w1": pa.int64(), "w2": pa.int64(), "offset": pa.int32(), "d1": pa.int64(), "d2": pa.int64(),
             "start": pa.int64(), "known": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                out: dict[str, list] = {c: [] for c in kinds}
                for row in batch.slice(first, 256).to_pylist():
                    for offset, p, window in _windows(row, need, size):
                        w = np.frombuffer(xxhash.xxh3_128_digest(window), dtype="<i8")
                        for c, v in zip(kinds, (int(w[0]), int(w[1]), offset, row["d1"], row["d2"], p, row["known"])):
                            out[c].append(v)
                yield _batch(out, kinds)

    rows = materialize(crowded.mapInArrow(
        run, "w1 bigint, w2 bigint, offset int, d1 bigint, d2 bigint, start bigint, known boolean"), "windows", folder)
    key = ["w1", "w2", "offset"]
    twice = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return rows.where("not known").join(twice, key).select(*DOC, "start", (F.col("start") + need).alias("end"))


def repeated_spans(texts: DataFrame, min_len: int = MIN_LEN, local_members: int = LOCAL_MEMBERS) -> DataFrame:
    """d1, d2 (the head of a text's SHA-256) and ``spans``, structs (start, end) that may overlap: together the bytes
    that windows met elsewhere cover. ``texts`` has digest and data, a row for each document.

    The spans are written; the tables of the rounds go as soon as nothing reads them any more."""
    spark, lengths = texts.sparkSession, Lengths(min_len)
    first, folder = staging_path(spark, "first-round"), staging_path(spark, "rounds")
    sampled = materialize(sample_positions(texts, lengths), "positions", first)
    met = sampled.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("k").alias("name"))
    live = materialize(sampled.join(ranked(met, "name"), F.col("k") == F.col("name")).select(
        F.col("rank_of_sorted").alias("rank"), "u", *DOC, "lo", "to_place", "more"), "ranked-positions", folder)
    discard(spark, first)

    pairs = materialize(live.groupBy("rank", "u").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(*DOC, "lo", "to_place", "more")).alias("one")), "rank-pairs", folder)
    twice = pairs.where("n > 1").select(F.col("rank").alias("of_rank"), F.col("u").alias("of_u"))
    past = live.join(twice, (F.col("rank") == F.col("of_rank")) & (F.col("u") == F.col("of_u"))).select(
        *DOC, F.col("lo").alias("start"), (F.col("lo") + F.col("more") + lengths.min_len).alias("end"))

    several = pairs.groupBy("rank").agg(F.count(F.lit(1)).alias("n_pairs")).where("n_pairs > 1").select(
        F.col("rank").alias("of_rank"))
    wanted = pairs.join(several, F.col("rank") == F.col("of_rank")).select(
        "rank", (F.col("n") > 1).alias("known"), "one.*")
    found = materialize(contexts(wanted, packed(texts), lengths), "contexts", folder)
    parts = materialize(blocks(found, lengths), "blocks", folder)

    key = ["rank", "block", "common", "common2"]
    all_bytes = F.struct("whole", "whole2")
    classes = parts.groupBy(*key).agg(
        F.count(F.lit(1)).alias("members"), (F.min(all_bytes) == F.max(all_bytes)).alias("agreed")).where("members > 1")
    reranked = ranked(classes, *key).select(
        *[F.col(c).alias(f"of_{c}") for c in key], "members", "agreed", F.col("rank_of_sorted").alias("rank2"))
    left = materialize(parts.join(reranked, [F.col(c) == F.col(f"of_{c}") for c in key]).select(
        *RUN, "block", "rank2", "members", "agreed"), "reranked-blocks", folder)

    top = F.least(F.col("to_place"), F.col("block") * lengths.block + (lengths.block - 1))
    least = F.greatest(F.col("to_place") - F.col("more"), F.col("block") * lengths.block)
    place = F.col("lo") + F.col("to_place")
    agreed = left.where("agreed and not known").select(
        *DOC, (place - top).alias("start"), (place - least + lengths.min_len).alias("end"))

    run_key = ["rank", *DOC, "lo"]
    members = left.where("not agreed").join(found.select(*run_key, "context"), run_key)
    near = members.where(F.col("members") <= local_members).repartition("rank2").sortWithinPartitions("rank2")
    compared = near.mapInArrow(lambda batches: _compare(batches, lengths), SPAN_FIELDS)
    counted = _count_windows(members.where(F.col("members") > local_members), lengths, folder)

    spans = past.union(agreed).union(compared).union(counted)
    found_spans = materialize(spans.groupBy(*DOC, "start").agg(F.max("end").alias("end")).groupBy(*DOC).agg(
        F.collect_list(F.struct("start", "end")).alias("spans")), "spans")
    discard(spark, folder)
    return found_spans


def named_texts(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``keep``, data (the text's bytes, none for a null text) and digest (its SHA-256)."""
    data = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    return docs.select(*[F.col(f"`{c}`") for c in keep], data.alias("data"), F.unhex(F.sha2(data, 256)).alias("digest"))


def packed(texts: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``keep``, d1, d2 and the packed text: what is shuffled is about a third of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                some = batch.slice(first, 512)
                names = np.frombuffer(b"".join([d[:16] for d in some.column("digest").to_pylist()]), dtype="<i8")
                blobs = [pack.compress(d) for d in some.column("data").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*[some.column(c) for c in keep], pa.array(names[0::2]), pa.array(names[1::2]),
                     pa.array(blobs, type=pa.binary())], names=[*keep, *DOC, "packed"])

    rows = texts.select(*[F.col(f"`{c}`") for c in keep], "digest", "data")
    declared = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema[:-2])
    return rows.mapInArrow(run, f"{declared}d1 bigint, d2 bigint, packed binary")


def stretches(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal stretches that the spans cover; spans that touch are one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def whole_words(data: bytes, start: int, end: int) -> int:
    """Words of ``data`` that lie wholly between the two places."""
    words = len(data[start:end].split())
    cut_left = start > 0 and not data[start - 1 : start].isspace() and not data[start : start + 1].isspace()
    cut_right = end < len(data) and not data[end - 1 : end].isspace() and not data[end : end + 1].isspace()
    return max(0, words - cut_left - cut_right)


def without(data: bytes, spans: list[dict], least_words: int = 0) -> tuple[bytes, int]:
    """What is left of ``data``, and the number of maximal stretches removed; those with fewer whole words stay."""
    left, at, n = [], 0, 0
    for start, end in stretches(spans):
        if not least_words or whole_words(data, start, end) >= least_words:
            left.append(data[at:start])
            at = end
            n += 1
    left.append(data[at:])
    return b"".join(left), n


def spans_inside(texts: DataFrame, short: DataFrame, min_len: int, local_members: int) -> DataFrame:
    """``repeated_spans`` for a longer window, looked for only where shorter repeated windows (``short``) lie.

    Every shorter window inside a repeated one is repeated too, so both of its places lie within stretches of ``short``;
    nothing is missed, and the rounds see only the repeated part of the corpus.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for i, blob in enumerate(batch.column("packed")):
                cuts = [c for c in stretches(batch.column("spans")[i].as_py()) if c[1] - c[0] >= min_len]
                if not cuts:
                    continue
                data = unpack.decompress(blob.as_py())
                parts = [data[a:b] for a, b in cuts]
                n = len(cuts)
                yield pa.RecordBatch.from_arrays([
                    pa.array([hashlib.sha256(p).digest() for p in parts], type=pa.binary()), pa.array(parts, type=pa.binary()),
                    pa.array([batch.column("d1")[i].as_py()] * n, type=pa.int64()),
                    pa.array([batch.column("d2")[i].as_py()] * n, type=pa.int64()),
                    pa.array([c[0] for c in cuts], type=pa.int64())], names=["digest", "data", "of1", "of2", "at"])

    folder = staging_path(texts.sparkSession, "inside")
    held_texts = packed(texts).join(short, list(DOC)).select(*DOC, "packed", "spans")
    parts = materialize(held_texts.mapInArrow(
        run, "digest binary, data binary, of1 bigint, of2 bigint, at bigint"), "repeated-parts", folder)
    found = repeated_spans(parts.select("digest", "data"), min_len, local_members)

    def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.frombuffer(b"".join([d[:16] for d in batch.column("digest").to_pylist()]), dtype="<i8")
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[0::2]), pa.array(names[1::2]), *[batch.column(c) for c in ("of1", "of2", "at")]],
                names=[*DOC, "of1", "of2", "at"])

    places = parts.select("digest", "of1", "of2", "at").mapInArrow(
        head, "d1 bigint, d2 bigint, of1 bigint, of2 bigint, at bigint").distinct()  # equal texts have equal parts
    shifted = places.join(found, list(DOC)).select(F.col("of1").alias("d1"), F.col("of2").alias("d2"), F.transform(
        "spans", lambda s: F.struct((s["start"] + F.col("at")).alias("start"), (s["end"] + F.col("at")).alias("end"))).alias("spans"))
    inside = materialize(shifted.groupBy(*DOC).agg(F.flatten(F.collect_list("spans")).alias("spans")), "inside-spans")
    discard(texts.sparkSession, folder)
    return inside


def strip_repeats(
    docs: DataFrame, keep: Sequence[str] = ("doc_id",), min_len: int = MIN_LEN, local_members: int = LOCAL_MEMBERS,
    as_text: bool = False, least_words: int = 0, passages: tuple[int, int] | None = None,
) -> DataFrame:
    """``keep``, kept (the remaining bytes), n_bytes, n_removed and n_spans of every document.

    ``passages``, a shorter length in bytes and a number of words, adds n_passages and n_passage_bytes: the maximal stretches
    of strings of that length that are met elsewhere, if they hold so many whole words, and their bytes.

    With ``as_text``, kept is text: of a character that a cut goes through nothing is left. With ``least_words``, a maximal
    repeated stretch goes only if it holds so many whole words.

    Null and empty texts have nothing to remove, nor have texts shorter than ``min_len`` bytes. Repeated rows are
    copies of one another and lose all windows. Every row comes out, null ids too; an empty table gives no rows.
    """
    keep = list(keep)
    small_batches(docs.sparkSession)
    texts = named_texts(docs, keep)
    if passages is None:
        spans = repeated_spans(texts, min_len, local_members).select(*DOC, "spans", F.lit(None).cast(
            "array<struct<start:bigint,end:bigint>>").alias("short"))
    else:
        short = repeated_spans(texts, passages[0], local_members)
        long = spans_inside(texts, short, min_len, local_members)
        spans = short.withColumnRenamed("spans", "short").join(long, list(DOC), "left").select(*DOC, "spans", "short")
    added = ["n_passages", "n_passage_bytes"] if passages else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                some = batch.slice(first, 512)
                kept, numbers = [], []
                for blob, cut, near in zip(*[some.column(c).to_pylist() for c in ("packed", "spans", "short")]):
                    data = unpack.decompress(blob)
                    rest, n = without(data, cut, least_words) if cut else (data, 0)
                    kept.append(rest.decode("utf-8", "ignore") if as_text else rest)
                    sizes = [b - a for a, b in stretches(near or []) if whole_words(data, a, b) >= passages[1]] if passages else []
                    numbers.append((len(data), len(data) - len(rest), n, len(sizes), sum(sizes)))
                names = ["n_bytes", "n_removed", "n_spans", *added]
                yield pa.RecordBatch.from_arrays(
                    [*[some.column(c) for c in keep], pa.array(kept, type=pa.string() if as_text else pa.binary()),
                     *[pa.array([row[i] for row in numbers], type=pa.int64()) for i in range(len(names))]],
                    names=[*keep, "kept", *names])

    joined = packed(texts, keep).join(spans, list(DOC), "left").select(
        *[F.col(f"`{c}`") for c in keep], "packed", "spans", "short")
    declared = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in joined.schema[:-3])
    more = "".join(f", {c} bigint" for c in ["n_bytes", "n_removed", "n_spans", *added])
    return joined.mapInArrow(run, f"{declared}kept {'string' if as_text else 'binary'}{more}")
