"""Token ids in binary files: frequency-ranked, byte-aligned, with the control bytes apart from the data.

Ids are replaced by their rank among all ids of the corpus, the most frequent first. A rank takes as few bytes as it
needs, least significant byte first; how many is said by control bits kept in bytes of their own: one bit an id while
ranks fit two bytes (eight ids a control byte), else two bits (four ids). A control byte indexes a table of the lengths
it stands for, so numpy decodes whole blocks without a loop.

A file is a run of blocks, each followed by ``END``. A block holds the ids of consecutive documents:

    magic 8 bytes | shard, number in shard, documents, of these without an id, bits an id: 5 x uint32
    | ids, data bytes: 2 x uint64
    | doc_id int64 each | ids uint32 each | control bytes | data bytes

Blocks and documents ascend by doc_id through the files in the order of their names; those without a doc_id come first. The rank table is a file of its
own, ``ranks/part-*``: uint32 ids, the most frequent first.
"""

from __future__ import annotations

import gc
import os
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioguard.llm.common import held, per_text, release
from folioguard.session import materialize

MAGIC = b"FQVB0001"
END = b"\nEND\n"
HEADER = struct.Struct("<8sIIIIIQQ")
# Fixed value: the split pattern of the word-level vocabulary.
PIECE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# White space but line feeds, the start of a special string, and the letter whose lower case hangs on its place.
UNEASY = regex.compile(r"[^\S\n]|<\||Σ")
CACHED_WORDS = 800_000
CACHED_PIECES = 500_000
TOGETHER = 128
BATCH_CHARS = 6_000_000
BLOCK_IDS = 1 << 20
FILE_IDS = 1 << 23
SHARD_GROUP = 1024


# -- the byte coding

@lru_cache(maxsize=2)
def length_table(bits: int) -> np.ndarray:
    """Lengths that each control byte stands for, first id in the lowest bits."""
    per = 8 // bits
    control = np.arange(256, dtype=np.uint16)
    return np.stack([((control >> (bits * i)) & ((1 << bits) - 1)) + 1 for i in range(per)], axis=1).astype(np.uint8)


def pack(ranks: np.ndarray, bits: int) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of ``ranks``."""
    extra = (ranks > 0xFF).astype(np.uint8)  # bytes beyond the first
    if bits > 1:
        extra += ranks > 0xFFFF
        extra += ranks > 0xFFFFFF
    ends = np.cumsum(extra, dtype=np.int32)
    data = np.empty(len(ranks) + int(ends[-1]) if len(ranks) else 0, dtype=np.uint8)
    starts = np.arange(len(ranks), dtype=np.int32)
    starts += ends
    starts -= extra
    data[starts] = ranks.astype(np.uint8)
    for i in range(1, 1 << bits):
        longer = np.flatnonzero(extra >= i)
        data[starts[longer] + i] = (ranks[longer] >> np.uint32(8 * i)).astype(np.uint8)
    if bits == 1:
        return np.packbits(extra, bitorder="little").tobytes(), data.tobytes()
    extra = np.concatenate([extra, np.zeros(-len(extra) % 4, dtype=np.uint8)])
    return (extra[0::4] | extra[1::4] << 2 | extra[2::4] << 4 | extra[3::4] << 6).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int, bits: int) -> np.ndarray:
    """The ``n`` ranks behind control and data bytes."""
    lengths = length_table(bits)[np.frombuffer(control, dtype=np.uint8)].reshape(-1)[:n]
    starts = np.cumsum(lengths, dtype=np.int32)  # a block has far fewer bytes
    starts -= lengths
    padded = np.frombuffer(data + b"\0\0\0", dtype=np.uint8)
    ranks = padded[starts].astype(np.uint32)
    for i in range(1, 1 << bits):
        more = np.flatnonzero(lengths > i)
        ranks[more] |= padded[starts[more] + i].astype(np.uint32) << np.uint32(8 * i)
    return ranks


# -- tokens

class WordIds(dict):
    """Ids, as bytes, of the words between white space; bounded by ``CACHED_WORDS``.

    A new word is cut into the pieces that the tokenizer's own split makes, and the library codes pieces not met
    before. Words for which that cut could differ (odd white space, special strings, letters whose lower case or normal
    form hangs on their neighbours) go to the library whole.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.kind = "<u2" if self.code == "H" else "<u4"
        self.pieces: dict[str, bytes] = {"\n": b""}
        vocab = self.tokenizer.get_vocab()
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None) or "\0"
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        splits = PIECE_SPLIT in self.tokenizer.pre_tokenizer.__getstate__().decode().replace("\\\\", "\\")
        self.cut = regex.compile(r"\n|" + PIECE_SPLIT) if splits else None

    def library(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, c.ids).tobytes() for c in self.tokenizer.encode_batch_fast(
            texts, add_special_tokens=False)]

    def library_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces, coded by the library many in one text; an entry that ends a word ends a piece."""
        out: list[bytes] = []
        groups = [pieces[i : i + TOGETHER] for i in range(0, len(pieces), TOGETHER)]
        for group, raw in zip(groups, self.library([" ".join(g) for g in groups])):
            stops = ((np.flatnonzero(self.ends[np.frombuffer(raw, dtype=self.kind)]) + 1) * int(self.kind[2])).tolist()
            if len(stops) == len(group):
                out += [raw[a:b] for a, b in zip([0, *stops], stops)]
            else:
                out += self.library(group)
        return out

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, one word's after another's, and how many each has."""
        coded = list(map(self.get, words))
        places = [i for i, c in enumerate(coded) if c is None]
        if places:
            new = [words[i] for i in places]
            if len(self) + len(new) > CACHED_WORDS:
                self.clear()
            self.learn(new)
            for i, word in zip(places, new):
                coded[i] = self[word]
        lengths = np.fromiter(map(len, coded), dtype=np.int32, count=len(coded)) // np.dtype(self.kind).itemsize
        return np.frombuffer(b"".join(coded), dtype=self.kind), lengths

    def learn(self, new: list[str]) -> None:
        joined = "\n".join(["", *new])
        if (self.cut is None or joined.count("\n") > len(new) or UNEASY.search(joined)
                or not is_normalized("NFC", joined)):
            easy = [self.cut is not None and "\n" not in w and not UNEASY.search(w) and is_normalized("NFC", w)
                    for w in new]
            whole = [w for w, e in zip(new, easy) if not e]
            self.update(zip(whole, self.library(whole)))
            new = [w for w, e in zip(new, easy) if e]
            joined = "\n".join(["", *new])
        if not new:
            return
        pieces = self.cut.findall(joined.lower())
        known = self.pieces
        fresh = list(set(pieces) - known.keys())
        if len(known) + len(fresh) > CACHED_PIECES:
            known.clear()
            known["\n"] = b""
            fresh = list(set(pieces) - known.keys())
        known.update(zip(fresh, self.library_pieces(fresh)))
        coded = list(map(known.__getitem__, pieces))
        starts = [i + 1 for i, p in enumerate(pieces) if p == "\n"]
        stops = [*[i - 1 for i in starts[1:]], len(pieces)]
        self.update(zip(new, [
            coded[a] if b - a == 1 else b"".join(coded[a:b]) for a, b in zip(starts, stops)]))


def word_ids(path: str) -> WordIds:
    """A worker reads the file once."""
    return held(f"words {path}", lambda: WordIds(path))


def encode_texts(path: str, texts: list[str], end: int) -> Iterator[np.ndarray]:
    """The library's ids of each text, then ``end``.

    The tokenizer lower-cases, drops white space and merges only between it, so a text's ids are those of its
    lower-cased words one after the other. Special strings have no capitals. Words are told apart by Arrow, looked up once a batch, and their ids gathered as arrays.
    """
    known = word_ids(path)
    start = 0
    while start < len(texts):
        stop, size = start, 0
        while stop < len(texts) and size < BATCH_CHARS:
            size += len(texts[stop])
            stop += 1
        plain = [t if "Σ" in t else t.lower() for t in texts[start:stop]]  # one letter's lower case hangs on its place
        words = pc.ascii_split_whitespace(pa.array(plain, type=pa.string()))
        coded = words.flatten().dictionary_encode()
        ids, lengths = known.of(coded.dictionary.to_pylist())
        places = np.cumsum(lengths, dtype=np.int32) - lengths
        index = coded.indices.to_numpy()
        n = lengths[index]
        ends = np.concatenate([[0], np.cumsum(n, dtype=np.int32)])
        where = np.repeat(places[index] - ends[:-1].astype(np.int32), n)
        where += np.arange(len(where), dtype=np.int32)
        run = ids[where]
        cuts = ends[words.offsets.to_numpy()].tolist()
        for a, b in zip(cuts, cuts[1:]):
            yield np.append(run[a:b], run.dtype.type(end))
        start = stop


def encode(docs: DataFrame, path: str, end: int) -> DataFrame:
    """doc_id, the packed ids of every text, and in some rows ``seen``, how often the ids of that and the rows around it
    occur; a null text is an empty one, null ids and repeats are kept."""

    def prepare():
        pack = zstandard.ZstdCompressor(level=1)

        def work(texts: list[str]) -> dict:
            gc.disable()  # millions of strings and no cycles among them: nothing for it to find
            try:
                coded = list(encode_texts(path, texts, end))
            finally:
                gc.enable()
            seen = np.bincount(np.concatenate(coded)).astype("<u4")
            return {"ids": [pack.compress(i.tobytes()) for i in coded], "width": [i.itemsize for i in coded],
                    "seen": [pack.compress(seen.tobytes()), *[None] * (len(texts) - 1)]}

        return work

    return per_text(docs, ["doc_id"], prepare, "ids binary, width int, seen binary", rows=2048, large_batches=True)


def unpacked(ids: bytes, width: int) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(ids), dtype=f"<u{width}")


def id_counts(coded: DataFrame) -> DataFrame:
    """token and n over all documents: a row for each id in use, at most as many as the vocabulary has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for blob in batch.column("seen").to_pylist():
                seen = np.frombuffer(zstandard.decompress(blob), dtype="<u4")
                if len(seen) > len(total):
                    total = np.concatenate([total, np.zeros(len(seen) - len(total), dtype=np.int64)])
                total[: len(seen)] += seen
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"token": used, "n": total[used]})

    return coded.where("seen is not null").select("seen").mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(
        F.sum("n").alias("n"))


# -- files

def _write(rows: DataFrame, column: str, path: str) -> None:
    """The bytes in ``column``, each followed by ``END``, as files below ``path``."""
    rows.select(F.col(column).cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option(
        "lineSep", END.decode("latin-1")).text(path)


def _block(
    shard: int, number: int, bits: int, docs: list[int | None], parts: list[np.ndarray], rank: np.ndarray
) -> bytes:
    ids = np.concatenate(parts)
    control, data = pack(rank[ids], bits)
    head = HEADER.pack(MAGIC, shard, number, len(docs), docs.count(None), bits, len(ids), len(data))
    return b"".join([head, np.array([d or 0 for d in docs], dtype="<i8").tobytes(),
                     np.array([len(p) for p in parts], dtype="<u4").tobytes(), control, data])


def write_files(coded: DataFrame, path: str) -> None:
    """Files below ``path`` with the documents of ``encode`` in ascending doc_id order.

    Frequencies come from all documents. The rank table has an entry for each id in use, so the vocabulary bounds it.
    """
    spark = coded.sparkSession
    counts = id_counts(coded).collect()
    ranked = np.array([t for t, _ in sorted(counts, key=lambda c: (-c["n"], c["token"]))], dtype="<u4")
    total = sum(c["n"] for c in counts)
    bits = 1 if len(ranked) <= 1 << 16 else 2
    _write(spark.createDataFrame([(bytearray(ranked.tobytes()),)], "ranks binary").coalesce(1), "ranks", f"{path}/ranks")
    book = spark.sparkContext.broadcast(ranked.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        order = np.frombuffer(book.value, dtype="<u4")
        rank = np.zeros(int(order.max(initial=0)) + 1, dtype=np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        shard, number, held = TaskContext.get().partitionId(), 0, 0
        docs: list[int | None] = []
        parts: list[np.ndarray] = []
        for batch in batches:
            for doc, ids, width in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "ids", "width")]):
                parts.append(unpacked(ids, width))
                docs.append(doc)
                held += len(parts[-1])
                if held >= BLOCK_IDS:
                    yield pa.RecordBatch.from_pydict({"block": [_block(shard, number, bits, docs, parts, rank)]})
                    docs, parts, held, number = [], [], 0, number + 1
        if docs:
            yield pa.RecordBatch.from_pydict({"block": [_block(shard, number, bits, docs, parts, rank)]})

    files = max(1, -(-total // FILE_IDS))
    order = F.col("doc_id").cast("bigint").asc_nulls_first()
    dealt = coded.drop("seen").repartitionByRange(files, order).sortWithinPartitions(order)
    _write(dealt.mapInArrow(run, "block binary"), "block", f"{path}/ids")


def _blocks(content: bytes) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray]]:
    """shard, doc_ids, lengths and ranks of each block of a file."""
    at = 0
    while at < len(content):
        magic, shard, number, n_docs, n_absent, bits, n_ids, n_data = HEADER.unpack_from(content, at)
        if magic != MAGIC:
            raise ValueError(f"no block at byte {at}")
        at += HEADER.size
        docs = np.frombuffer(content, dtype="<i8", count=n_docs, offset=at)
        at += 8 * n_docs
        lengths = np.frombuffer(content, dtype="<u4", count=n_docs, offset=at)
        at += 4 * n_docs
        n_control = -(-n_ids * bits // 8)
        control, data = content[at : at + n_control], content[at + n_control : at + n_control + n_data]
        at += n_control + n_data
        if content[at : at + len(END)] != END:
            raise ValueError(f"block does not end at byte {at}")
        at += len(END)
        ids = pa.array(docs, mask=np.arange(n_docs) < n_absent)
        yield shard, ids, lengths, unpack(control, data, n_ids, bits)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files below ``path``.

    ``start`` counts the ids of all documents before it. Each file tells the ids before it within itself; the files'
    totals, a number each, are summed in two steps so that no task holds them all.
    """
    stored = bytes(spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/ranks").select(
        "content").first()["content"])
    book = spark.sparkContext.broadcast(stored[: -len(END)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        order = np.frombuffer(book.value, dtype="<u4")
        for batch in batches:
            for content in batch.column("content"):
                before = 0
                for shard, docs, lengths, ranks in _blocks(content.as_py()):
                    raw = memoryview(order[ranks].astype("<u4").tobytes())
                    ends = np.cumsum(lengths, dtype=np.int64)
                    starts = ends - lengths
                    crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                    yield pa.RecordBatch.from_pydict({
                        "shard": pa.array(np.full(len(docs), shard, dtype=np.int64)), "doc_id": docs,
                        "within": starts + before, "n_tokens": lengths.astype(np.int64),
                        "ids_crc32": pa.array(crcs, type=pa.int64())})
                    before += int(ends[-1])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/ids")
    rows = materialize(files.select("content").mapInArrow(
        run, "shard bigint, doc_id bigint, within bigint, n_tokens bigint, ids_crc32 bigint"), "token-rows")
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n")).withColumn(
        "group", F.floor(F.col("shard") / SHARD_GROUP))
    earlier = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("group").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    groups = totals.groupBy("group").agg(F.sum("n").alias("m")).select(
        F.col("group").alias("of_group"), F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("base"))
    places = totals.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(
        groups, F.col("group") == F.col("of_group")).select(
        F.col("shard").alias("of_shard"), (F.col("base") + F.col("inside")).alias("before"))
    return rows.join(places, F.col("shard") == F.col("of_shard")).select(
        "doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def file_round_trip(docs: DataFrame, tokenizer: str, path: str, end: int = 2) -> DataFrame:
    """Encode ``docs`` (doc_id, text), write the ids below ``path``, and return what the files hold.

    Null and empty texts have the end id alone. Rows without a doc_id come first, repeated doc_ids stand side by side.
    An empty table gives no rows.
    """
    coded = materialize(encode(docs, tokenizer, end), "token-ids")
    write_files(coded, path)
    return read_files(docs.sparkSession, path)

