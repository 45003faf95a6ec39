"""CSV files in byte ranges: quoted line ends do not keep a large file in one task.

Spark's text reader deals a file out in ranges of whole lines. What a range does to the quoting state is a map from either
start state, outside or inside quotes, to the end state, the records that end in it and the widest of them; maps compose.
A first pass makes the maps, a two-step scan (ranges into groups, groups into files) composes them, and then every range
knows the state it starts in, so records are read in ranges too. A record over a range's end is put together from its
pieces by a grouping on the range where it starts.

All allowed delimiters are counted at once, so the sample for the delimiter comes from the same pass.
"""

from __future__ import annotations

import csv
import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioguard.fixed_values import DELIMITERS, DELIMITER_SAMPLE
from folioguard.session import materialize, staging_path

RANGE_BYTES = 32 << 20
MOST_RANGES = 200_000  # larger inputs get larger ranges, which bounds the table of ranges that start inside quotes
GROUP_RANGES = 256
HEADER_BYTES = 1 << 20
WHOLE_FILE = 1 << 60
LF, CR, QUOTE = 10, 13, 34
Paths = str | Sequence[str]


def split_session(spark: SparkSession, range_bytes: int) -> SparkSession:
    """A session whose splits depend on the files alone, so that two passes see the same ranges."""
    session = spark.newSession()
    session.conf.set("spark.sql.files.maxPartitionBytes", str(range_bytes))
    session.conf.set("spark.sql.files.openCostInBytes", "65536")
    session.conf.set("spark.sql.files.minPartitionNum", "1")
    session.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    return session


def listed_files(spark: SparkSession, path: Paths) -> DataFrame:
    """path, length and file, the number that stands for the file in this module; nothing is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.xxhash64("_metadata.file_path").alias("file"))


def range_bytes_for(files: DataFrame, least: int = RANGE_BYTES) -> int:
    total = files.agg(F.sum("length")).first()[0] or 0
    return max(least, -(-total // MOST_RANGES))


def file_lines(spark: SparkSession, path: Paths, range_bytes: int, max_bytes: int = WHOLE_FILE) -> DataFrame:
    """Of files up to ``max_bytes``: file, block (where the line's range starts), size of the file, and line, its bytes up to a line feed; in order."""
    lines = split_session(spark, range_bytes).read.option("lineSep", "\n").option("recursiveFileLookup", True).text(path)
    return lines.where(F.col("_metadata.file_size") <= max_bytes).select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("line"))


# -- maps of quoting states

@dataclass
class FromState:
    """What a stretch does if it starts outside or inside quotes. ``n`` and ``widest`` (cells, by delimiter) are of the
    records that start in it and end in it; ``head`` and ``tail`` are the delimiters of the open ends."""

    end: int
    closed: bool = True  # whether the record that is open at the start ends here
    n: int = 0
    widest: np.ndarray = field(default_factory=lambda: np.zeros(len(DELIMITERS), dtype=np.int64))
    head: np.ndarray = field(default_factory=lambda: np.zeros(len(DELIMITERS), dtype=np.int64))
    tail: np.ndarray = field(default_factory=lambda: np.zeros(len(DELIMITERS), dtype=np.int64))
    opened: int = -1  # the block where the record that is open at the end starts, -1 if it was open at the start
    first: bytes = b""  # the head's bytes, or the first record that is not blank

    def first_is_open(self, start: int) -> bool:
        return not self.closed if start else bool(self.first) and not self.n


StateMap = tuple[FromState, FromState]
EMPTY: StateMap = (FromState(0), FromState(1, closed=False))


def _then(a: FromState, start: int, following: StateMap) -> FromState:
    b = following[a.end]
    if a.first_is_open(start):
        first = (a.first + following[1].first)[:HEADER_BYTES]
    else:
        first = a.first or (b"" if start else b.first)
    if not a.end:
        return FromState(b.end, a.closed, a.n + b.n, np.maximum(a.widest, b.widest), a.head, b.tail, b.opened, first)
    if not a.closed:  # still the record that was open at the start
        return FromState(b.end, b.closed, b.n, b.widest, a.head + b.head, b.tail, b.opened, first)
    if not b.closed:
        return FromState(1, True, a.n, a.widest, a.head, a.tail + b.head, a.opened, first)
    widest = np.maximum(np.maximum(a.widest, b.widest), a.tail + b.head + 1)
    return FromState(b.end, True, a.n + 1 + b.n, widest, a.head, b.tail, b.opened, first)


def compose(a: StateMap, b: StateMap) -> StateMap:
    return _then(a[0], 0, b), _then(a[1], 1, b)


def record_ends(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of line ends (LF, or CR without LF) of whole lines, and for each whether it is inside quotes if the
    lines start outside."""
    inside = np.logical_xor.accumulate(data == QUOTE)
    ends = data == LF
    lone = data == CR
    lone[:-1] &= data[1:] != LF
    places = np.flatnonzero(ends | lone)
    return places, inside


def measure(data: np.ndarray, block: int) -> StateMap:
    """The map of whole lines of a range, each with its line feed."""
    places, inside = record_ends(data)
    out = []
    for start in (0, 1):
        ends = places[inside[places] == bool(start)]
        begins = np.append(0, ends[:-1] + 1) if len(ends) else ends
        blank = (ends == begins) | ((ends == begins + 1) & (data[begins] == CR)) if len(ends) else np.zeros(0, dtype=bool)
        counts = np.zeros((len(DELIMITERS), len(ends) + 1), dtype=np.int64)
        for i, mark in enumerate(DELIMITERS):
            at = np.flatnonzero(data == ord(mark))
            at = at[inside[at] == bool(start)]
            counts[i] = np.bincount(np.searchsorted(ends, at), minlength=len(ends) + 1)
        own = FromState(int(inside[-1]) ^ start)
        full = ~blank
        if start:
            own.closed = len(ends) > 0
            own.head = counts[:, 0]
            own.first = data[: int(ends[0]) + 1 if own.closed else len(data)][:HEADER_BYTES].tobytes()
            full[:1] = False
        elif full.any():
            i = int(np.argmax(full))
            own.first = data[int(begins[i]) : int(ends[i]) + 1][:HEADER_BYTES].tobytes()
        elif own.end:
            own.first = data[int(ends[-1]) + 1 if len(ends) else 0 :][:HEADER_BYTES].tobytes()
        own.n = int(full.sum())
        if own.n:
            own.widest = counts[:, :-1][:, full].max(axis=1) + 1
        if len(ends) or not start:
            own.tail, own.opened = counts[:, -1], block if own.end else -1
        out.append(own)
    return out[0], out[1]


SIZES = 4 + 3 * len(DELIMITERS)
MAP_FIELDS = "m array<bigint>, first0 binary, first1 binary"
RANGE_FIELDS = (f"file bigint, block bigint, {MAP_FIELDS}, bytes bigint, n_lines bigint, nul boolean, invalid boolean, "
                "sample binary")


def _packed(state: StateMap) -> dict:
    numbers = [int(x) for s in state for x in (
        s.end, s.closed, s.n, s.opened, *s.widest, *s.head, *s.tail)]
    return {"m": numbers, "first0": state[0].first, "first1": state[1].first}


def _unpacked(m: Sequence[int], first0: bytes, first1: bytes) -> StateMap:
    out, k = [], len(DELIMITERS)
    for s, first in enumerate((first0, first1)):
        v = np.asarray(m[s * SIZES : (s + 1) * SIZES], dtype=np.int64)
        widest, head, tail = v[4:].reshape(3, k)
        out.append(FromState(int(v[0]), bool(v[1]), int(v[2]), widest, head, tail, int(v[3]), bytes(first or b"")))
    return out[0], out[1]


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, int]]:
    """Stretches of one range in a batch: file, block, from, to."""
    if not batch.num_rows:
        return
    file, block = batch.column("file").to_numpy(), batch.column("block").to_numpy()
    cuts = np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(file)]):
        yield int(file[a]), int(block[a]), a, b


def _is_utf8(data: bytes) -> bool:
    try:
        data.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


def range_maps(spark: SparkSession, path: Paths, range_bytes: int, max_bytes: int = WHOLE_FILE) -> DataFrame:
    """A row for each range: its map, its lines and bytes (a line feed for each line included), whether it has NUL bytes
    or bytes that are no UTF-8, and what it holds of the first ``4 * DELIMITER_SAMPLE`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: tuple[int, int] | None = None
        state, sizes, flags, sample = EMPTY, [0, 0], [False, False], b""

        def row() -> pa.RecordBatch:
            values = {"file": place[0], "block": place[1], **_packed(state), "bytes": sizes[0], "n_lines": sizes[1],
                      "nul": flags[0], "invalid": flags[1], "sample": sample}
            kinds = {"m": pa.list_(pa.int64()), "first0": pa.binary(), "first1": pa.binary(), "nul": pa.bool_(),
                     "invalid": pa.bool_(), "sample": pa.binary()}
            return pa.RecordBatch.from_arrays(
                [pa.array([v], type=kinds.get(c, pa.int64())) for c, v in values.items()], names=list(values))

        for batch in batches:
            lines = batch.column("line").to_pylist()
            for file, block, a, b in _runs(batch):
                if (file, block) != place:
                    if place is not None:
                        yield row()
                    place, state, sizes, flags, sample = (file, block), EMPTY, [0, 0], [False, False], b""
                raw = b"\n".join([*lines[a:b], b""])
                state = compose(state, measure(np.frombuffer(raw, dtype=np.uint8), block))
                sizes = [sizes[0] + len(raw), sizes[1] + b - a]
                flags = [flags[0] or b"\0" in raw, flags[1] or not _is_utf8(raw)]
                lacking = 4 * DELIMITER_SAMPLE - block - len(sample)
                sample += raw[: max(lacking, 0)]
        if place is not None:
            yield row()

    made = file_lines(spark, path, range_bytes, max_bytes).select("file", "block", "line").mapInArrow(run, RANGE_FIELDS)
    return materialize_in(spark, made, "ranges").withColumn(
        "part", F.floor(F.col("block") / F.lit(range_bytes * GROUP_RANGES)))


def materialize_in(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """Written from the reading session, read back in the caller's."""
    path = staging_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _folded(rows: pd.DataFrame) -> StateMap:
    state = EMPTY
    for r in rows.itertuples(index=False):
        state = compose(state, _unpacked(r.m, r.first0, r.first1))
    return state


def group_maps(ranges: DataFrame) -> DataFrame:
    """First step of the scan: one map for each group of neighbouring ranges; second step input."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        packed = _packed(_folded(rows))
        return pd.DataFrame([{"file": rows["file"].iloc[0], "part": rows["part"].iloc[0], **packed}])

    return materialize(ranges.select("file", "part", "block", "m", "first0", "first1").groupBy("file", "part").applyInPandas(
        fold, f"file bigint, part bigint, {MAP_FIELDS}"), "range-groups")


FACT_FIELDS = "file bigint, n_records bigint, is_open boolean, widest array<bigint>, header binary"


def file_facts(ranges: DataFrame, groups: DataFrame) -> DataFrame:
    """Per file: n_records (blank ones apart, the header included), is_open (a quote never closes), widest (cells of the
    widest record, by delimiter), header, bytes, n_lines, nul, invalid and sample."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        state = _folded(rows.sort_values("part"))[0]
        return pd.DataFrame([{
            "file": rows["file"].iloc[0], "n_records": state.n, "is_open": bool(state.end),
            "widest": state.widest.tolist(), "header": state.first}])

    whole = groups.groupBy("file").applyInPandas(fold, FACT_FIELDS)
    sums = ranges.groupBy("file").agg(
        F.sum("bytes").alias("bytes"), F.sum("n_lines").alias("n_lines"), F.bool_or("nul").alias("nul"),
        F.bool_or("invalid").alias("invalid"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.octet_length("sample") > 0, F.struct(
            "block", "sample")))), lambda b: b["sample"].cast("string")), "").alias("sample"))
    return whole.join(sums, "file")


PLACE_FIELDS = "file bigint, block bigint, state int, header_here boolean, owner bigint, owner_is_header boolean"


def inside_ranges(ranges: DataFrame, groups: DataFrame) -> DataFrame:
    """file, block, state, header_here, owner and owner_is_header of the ranges that are unlike the others: they start
    inside quotes, in a record that starts in block ``owner``, or have the header though they are not the first."""

    def before(rows: pd.DataFrame) -> pd.DataFrame:
        """Second step of the scan: what lies before each group of a file."""
        out, state = [], EMPTY[0]
        for r in rows.sort_values("part").itertuples(index=False):
            out.append({"file": r.file, "part": r.part, **_packed((state, EMPTY[1]))})
            state = _then(state, 0, _unpacked(r.m, r.first0, r.first1))
        return pd.DataFrame(out)

    def places(rows: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        out = []
        state = _unpacked(given["m"].iloc[0], given["first0"].iloc[0], given["first1"].iloc[0])[0]
        for r in rows.sort_values("block").itertuples(index=False):
            header = state.first_is_open(0)
            if state.end:
                out.append((r.file, r.block, 1, False, state.opened, header))
            elif not state.first and r.block > 0:
                out.append((r.file, r.block, 0, True, -1, False))
            state = _then(state, 0, _unpacked(r.m, r.first0, r.first1))
        return pd.DataFrame(out, columns=[f.split()[0] for f in PLACE_FIELDS.split(", ")])

    starts = materialize(groups.groupBy("file").applyInPandas(before, f"file bigint, part bigint, {MAP_FIELDS}"), "group-starts")
    own = ranges.select("file", "part", "block", "m", "first0", "first1")
    return own.groupBy("file", "part").cogroup(starts.groupBy("file", "part")).applyInPandas(places, PLACE_FIELDS)


# -- records

RECORD_FIELDS = "file bigint, owner bigint, part bigint, header boolean, record binary"


def _pieces(lines: DataFrame) -> DataFrame:
    """Records of every range: whole ones have no owner; pieces of records over a range's end name the range where the
    record starts. ``header`` marks the file's first record."""
    kinds = {"file": pa.int64(), "owner": pa.int64(), "part": pa.int64(), "header": pa.bool_(), "record": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: tuple[int, int] | None = None
        state, header_due, rest = 0, False, b""
        owner, owner_header, closed = -1, False, True

        def some(file: int, owners, block: int, headers, records) -> pa.RecordBatch:
            n = len(records)
            return pa.RecordBatch.from_arrays([
                pa.array([file] * n, type=pa.int64()), pa.array(owners, type=pa.int64()),
                pa.array([block] * n, type=pa.int64()), pa.array(headers, type=pa.bool_()),
                pa.array(records, type=pa.binary())], names=list(kinds))

        def leave() -> Iterator[pa.RecordBatch]:
            if place is not None and rest:
                at, head = (owner, owner_header) if not closed else (place[1], header_due)
                yield some(place[0], [at], place[1], [head], [rest])

        for batch in batches:
            lines_here = batch.column("line").to_pylist()
            states, owners = batch.column("state").to_pylist(), batch.column("owner").to_pylist()
            heads, owner_heads = batch.column("header_here").to_pylist(), batch.column("owner_is_header").to_pylist()
            for file, block, a, b in _runs(batch):
                if (file, block) != place:
                    yield from leave()
                    place, rest = (file, block), b""
                    state, header_due = states[a] or 0, (block == 0 if heads[a] is None else heads[a])
                    closed = not state
                    owner, owner_header = (owners[a], owner_heads[a]) if state else (-1, False)
                raw = rest + b"\n".join([*lines_here[a:b], b""])
                data = np.frombuffer(raw, dtype=np.uint8)
                places, inside = record_ends(data)
                began = state if not closed else 0  # the state before what is in ``rest``
                ends = (places[inside[places] == bool(began)] + 1).tolist()
                if not ends:
                    rest = raw
                    continue
                cuts = [0, *ends]
                records = [raw[x:y] for x, y in zip(cuts, cuts[1:])]
                rest = raw[ends[-1] :]
                if not closed:
                    yield some(file, [owner], block, [owner_header], records[:1])
                    records, closed = records[1:], True
                if records:
                    marks = [False] * len(records)
                    if header_due:
                        for i, record in enumerate(records):
                            if record not in (b"\n", b"\r\n", b"\r"):
                                marks[i], header_due = True, False
                                break
                    yield some(file, [None] * len(records), block, marks, records)
        yield from leave()

    return lines.mapInArrow(run, RECORD_FIELDS)


def records(spark: SparkSession, path: Paths, range_bytes: int | None = None) -> DataFrame:
    """file, header (the file's first record) and record, the text of every record that is not blank, without its line
    end. Read in ranges whatever quoted cells hold; the bytes of one record are held by a task."""
    size = range_bytes or range_bytes_for(listed_files(spark, path))
    ranges = range_maps(spark, path, size)
    special = materialize(inside_ranges(ranges, group_maps(ranges)), "inside-ranges")
    lines = file_lines(spark, path, size)
    known = lines.join(F.broadcast(special), ["file", "block"], "left")  # at most MOST_RANGES rows
    pieces = _pieces(known.select("file", "block", "line", "state", "header_here", "owner", "owner_is_header"))
    text = F.rtrim(F.col("record").cast("string"), F.lit("\r\n"))
    whole = pieces.where("owner is null").select("file", "header", text.alias("record"))
    over = pieces.where("owner is not null").groupBy("file", "owner").agg(
        F.bool_or("header").alias("header"), F.sort_array(F.collect_list(F.struct("part", "record"))).alias("parts"))
    joined = over.select("file", "header", F.rtrim(F.array_join(F.transform(
        "parts", lambda p: p["record"].cast("string")), ""), F.lit("\r\n")).alias("record"))
    return whole.unionByName(joined).where("record != ''")


# -- whole-file facts

def file_digests(spark: SparkSession, path: Paths, max_bytes: int = WHOLE_FILE) -> DataFrame:
    """file and sha256 of its bytes. SHA-256 is sequential, so a file streams through one task, line by line; other files
    go to other tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, size, done, plain, marked = None, 0, 0, None, None

        def row() -> pa.RecordBatch:
            # The reader leaves a byte-order mark out; a last line may end without a line feed.
            lacking = size - done
            digest = marked if lacking >= 3 else plain
            if lacking in (1, 4):
                digest.update(b"\n")
            return pa.RecordBatch.from_arrays([pa.array([file]), pa.array([digest.hexdigest()])], names=["file", "sha256"])

        for batch in batches:
            lines, sizes = batch.column("line").to_pylist(), batch.column("size").to_pylist()
            for own, _, a, b in _runs(batch):
                if own != file:
                    if file is not None:
                        yield row()
                    file, size, done = own, sizes[a], 0
                    plain, marked = hashlib.sha256(), hashlib.sha256(b"\xef\xbb\xbf")
                    raw = b""
                else:
                    raw = b"\n"
                raw += b"\n".join(lines[a:b])
                done += len(raw)
                plain.update(raw)
                marked.update(raw)
        if file is not None:
            yield row()

    # A split as large as the largest file cuts no file, and no task is dealt more than that many bytes.
    most = listed_files(spark, path).where(F.col("length") <= max_bytes).agg(F.max("length")).first()[0]
    made = file_lines(spark, path, max(most or 0, RANGE_BYTES), max_bytes).mapInArrow(run, "file bigint, sha256 string")
    return materialize_in(spark, made, "digests")


def sniffer(allowed: Sequence[str]) -> Callable[[pd.Series], pd.Series]:
    """A function for the delimiter of the first 64 Ki characters of each file: what the standard library's sniffer finds
    (``unsupported`` if it is not allowed), else the first allowed one in the first line, else a comma."""

    def detect(samples: pd.Series) -> pd.Series:
        out = []
        for text in samples:
            if text is None:
                out.append(None)
                continue
            sample = text[:DELIMITER_SAMPLE]
            try:
                found = csv.Sniffer().sniff(sample).delimiter
            except csv.Error:
                lines = sample.splitlines()
                found = next((d for d in allowed if lines and d in lines[0]), ",")
            out.append(found if found in allowed else "unsupported")
        return pd.Series(out, dtype=object)

    return detect
