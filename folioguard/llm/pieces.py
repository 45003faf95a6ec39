"""SentencePiece encoding and decoding by a table of distinct chunks.

No piece of such a vocabulary goes on after a whitespace marker has ended a word, so a text cut before each run of
markers (and around line ends, which no piece holds) falls into chunks that are segmented independently. A worker keeps a
table of the distinct chunks it has met: each is segmented once, all new ones of a batch together as arrays, and the ids
go back to the chunks' places in one gather. Word occurrences are not shuffled: as rows they would be several times the
input. Decoding is a gather from an offset table of the pieces' bytes.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioguard.llm.bpe import IntTable
from folioguard.llm.common import held, per_text, small_batches

MARK = "▁"
LONG = 96  # longer chunks are merged one by one
CACHED_CHARS = 6_000_000  # of distinct chunks on a worker
BATCH_BYTES = 4_000_000
STRETCH = 500_000  # a longer text is cut at a space
GATHER = 1 << 20
NEVER = 1 << 30
PROBE = "Añb  ﬁx\n\ttab ▁x 🙂日本 the 1234 <s> <0x41>   end "

codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


class PieceTable:
    """A byte-pair model with kept spaces, a marker put before the text and no other normalisation."""

    def __init__(self, path: str, cached_chars: int = CACHED_CHARS):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.n, self.begin, self.end, self.unknown = n, model.bos_id(), model.eos_id(), model.unk_id()
        texts = [model.id_to_piece(i) for i in range(n)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)]
        raw = [model.is_byte(i) for i in range(n)]
        plain = [i for i in range(n) if not special[i] and not raw[i]]

        symbols = {texts[i]: i for i in plain}
        for i in plain:
            for char in texts[i]:
                symbols.setdefault(char, len(symbols) + n)
        self.of_char = np.full(0x110000, -1, dtype=np.int64)
        for text, symbol in symbols.items():
            if len(text) == 1:
                self.of_char[ord(text)] = symbol
        pairs = {}
        for i in plain:
            for cut in range(1, len(texts[i])):
                left, right = symbols.get(texts[i][:cut]), symbols.get(texts[i][cut:])
                if left is not None and right is not None:
                    pairs[left << 31 | right] = i
        self.pairs = IntTable(np.fromiter(pairs, dtype=np.int64, count=len(pairs)),
                              np.fromiter(pairs.values(), dtype=np.int64, count=len(pairs)))
        self.pair_of = pairs
        scores = np.array([model.get_score(i) for i in range(n)])
        self.order = np.append(np.unique(-scores, return_inverse=True)[1], NEVER)  # equal scores share a place; -1 comes last

        bytes_of = [bytes([int(t[3:5], 16)]) if r else t.replace(MARK, " ").encode() for t, r in zip(texts, raw)]
        for i in range(n):
            if special[i]:
                bytes_of[i] = model.decode([i]).encode() if model.is_unknown(i) else b""
        self.lengths = np.array([len(b) for b in bytes_of], dtype=np.int64)
        self.places = np.cumsum(self.lengths) - self.lengths
        self.pool = np.frombuffer(b"".join(bytes_of), dtype=np.uint8)
        self.silent = {i for i in range(n) if not bytes_of[i]}
        self.marked = {i for i in plain if texts[i].startswith(MARK)}
        self.byte_ids = np.full(256, self.unknown, dtype=np.int64)
        for i in range(n):
            if raw[i]:
                self.byte_ids[bytes_of[i][0]] = i
        self.falls_back = any(raw)

        self.apart = [ord(c) for c in "\n\r\t" if c not in symbols]
        self.cached_chars = cached_chars
        self._forget()
        if not self._fits(model, [texts[i] for i in plain]):
            raise ValueError("only byte-pair models that keep spaces, fall back to bytes and normalise nothing else")

    def _fits(self, model, pieces: list[str]) -> bool:
        inside = any(MARK in p.lstrip(MARK) for p in pieces)
        return not inside and self.falls_back and next(self.encode([PROBE])).tolist() == model.encode(PROBE)

    # -- the table of distinct chunks

    def _forget(self) -> None:
        self.row: dict[str, int] = {}
        self.chars = 0
        self.starts = np.zeros(0, dtype=np.int64)
        self.sizes = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.uint32)

    def _rows(self, chunks: list[str]) -> np.ndarray:
        """Places of distinct chunks in the table; those not met before are segmented."""
        new = [c for c in chunks if c not in self.row]
        if self.chars + sum(map(len, new)) > self.cached_chars and self.row:
            self._forget()
            new = chunks
        if new:
            short = [c for c in new if len(c) <= LONG]
            ids, sizes = self._segment([c.replace(" ", MARK) for c in short])
            long = [c for c in new if len(c) > LONG]
            own = [self._segment_long(c.replace(" ", MARK)) for c in long]
            ids = np.concatenate([self.ids, ids, *own]).astype(np.uint32)
            sizes = np.concatenate([sizes, np.fromiter(map(len, own), dtype=np.int64, count=len(own))])
            self.row.update(zip(short + long, range(len(self.row), len(self.row) + len(new))))
            self.chars += sum(map(len, new))
            self.starts = np.append(self.starts, len(self.ids) + np.cumsum(sizes) - sizes)
            self.sizes = np.append(self.sizes, sizes)
            self.ids = ids
        return np.fromiter(map(self.row.__getitem__, chunks), dtype=np.int64, count=len(chunks))

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        out = self.pairs.get((left << 31 | right) & ((1 << 62) - 1))
        out[(left < 0) | (right < 0)] = -1
        return out

    def _segment(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks, end to end, and their numbers: in each round every chunk merges its best pair, the
        leftmost of equal ones, until none has a pair left."""
        if not chunks:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        codes = np.frombuffer("".join(chunks).encode("utf-32-le"), dtype="<u4")
        owner = np.repeat(np.arange(len(chunks)), np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks)))
        symbol, at = self.of_char[codes], np.arange(len(codes))
        made = np.full(len(codes), -1, dtype=np.int64)
        made[:-1] = np.where(owner[1:] == owner[:-1], self._pair(symbol[:-1], symbol[1:]), -1)
        done: list[tuple[np.ndarray, ...]] = []
        while len(symbol):
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            best = np.minimum.reduceat(self.order[made] << 32 | np.arange(len(made)), first)
            alive = best >> 32 < NEVER
            if not alive.all():
                over = np.repeat(~alive, np.diff(np.append(first, len(symbol))))
                done.append((symbol[over], at[over], owner[over]))
                shift = np.cumsum(over)
                hit = best[alive] & 0xFFFFFFFF
                hit -= shift[hit]
                symbol, at, owner, made = symbol[~over], at[~over], owner[~over], made[~over]
            else:
                hit = best & 0xFFFFFFFF
            if not len(hit):
                continue
            symbol[hit] = made[hit]
            left = np.ones(len(symbol), dtype=bool)
            left[hit + 1] = False
            symbol, at, owner, made = symbol[left], at[left], owner[left], made[left]
            hit -= np.arange(len(hit))
            for place in (hit, hit[(hit > 0)] - 1):
                near = np.minimum(place + 1, len(symbol) - 1)
                joined = (near > place) & (owner[near] == owner[place])
                made[place] = np.where(joined, self._pair(symbol[place], symbol[near]), -1)
        symbol, at, owner = (np.concatenate(part) for part in zip(*done))
        order = np.argsort(at, kind="stable")
        return self._as_ids(symbol[order], codes[at[order]], owner[order], len(chunks))

    def _as_ids(self, symbol, code, owner, n_chunks) -> tuple[np.ndarray, np.ndarray]:
        """A character that is no piece becomes its bytes."""
        foreign = (symbol < 0) | (symbol >= self.n)
        width = np.where(foreign, 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000), 1)
        ids = np.repeat(symbol, width)
        if foreign.any():
            raw = code[foreign].astype("<u4").tobytes().decode("utf-32-le").encode()
            ids[np.repeat(foreign, width)] = self.byte_ids[np.frombuffer(raw, dtype=np.uint8)]
        return ids, np.bincount(owner, weights=width, minlength=n_chunks).astype(np.int64)

    def _segment_long(self, chunk: str) -> np.ndarray:
        """The same for one chunk, with a heap of pairs; entries whose symbols have changed since are passed over."""
        codes = np.frombuffer(chunk.encode("utf-32-le"), dtype="<u4")
        symbol = self.of_char[codes].tolist()
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        order, pair_of = self.order, self.pair_of
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(left: int) -> None:
            right = after[left]
            if right < n and symbol[left] >= 0 and symbol[right] >= 0:
                made = pair_of.get(symbol[left] << 31 | symbol[right])
                if made is not None:
                    heapq.heappush(heap, (int(order[made]), left, made, symbol[left], symbol[right]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, left, made, a, b = heapq.heappop(heap)
            right = after[left]
            if symbol[left] != a or right >= n or symbol[right] != b:
                continue
            symbol[left], symbol[right] = made, -2
            after[left] = after[right]
            if after[right] < n:
                before[after[right]] = left
            offer(left)
            if before[left] >= 0:
                offer(before[left])
        kept = np.array([i for i in range(n) if symbol[i] != -2])
        return self._as_ids(np.array(symbol)[kept], codes[kept], np.zeros(len(kept), dtype=np.int64), 1)[0]

    # -- texts

    def _stretches(self, texts: Sequence[str]) -> Iterator[tuple[int, bytes]]:
        """Bytes of each text with a blank for the marker put before it; long texts in parts that start at a blank."""
        for i, text in enumerate(texts):
            at = 0
            while at < len(text):
                cut = text.find(" ", at + STRETCH) if len(text) - at > STRETCH else -1
                cut = len(text) if cut < 0 else cut
                yield i, (" " * (at == 0) + text[at:cut].replace(MARK, " ")).encode()
                at = cut

    def _cut(self, stretches: list[bytes]) -> tuple[np.ndarray, pa.DictionaryArray]:
        """The number of chunks of each stretch, and all chunks by their place among the distinct ones."""
        data = np.frombuffer(b"".join(stretches), dtype=np.uint8)
        blank = data == 0x20
        start = blank.copy()
        start[1:] &= ~blank[:-1]
        for code in self.apart:
            alone = data == code
            start |= alone
            start[1:] |= alone[:-1]
        sizes = np.fromiter(map(len, stretches), dtype=np.int64, count=len(stretches))
        ends = np.cumsum(sizes)
        start[ends - sizes] = True
        at = np.flatnonzero(start)
        offsets = np.append(at, len(data)).astype(np.int64)
        chunks = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data))
        return np.diff(np.append(0, np.searchsorted(at, ends))), chunks.dictionary_encode()

    def encode(self, texts: Sequence[str]) -> Iterator[np.ndarray]:
        """Ids of each text, in order, without begin and end ids."""
        parts: list[list[np.ndarray]] = [[] for _ in texts]
        waiting: list[tuple[int, bytes]] = []
        size = 0

        def settle() -> None:
            if not waiting:
                return
            numbers, chunks = self._cut([s for _, s in waiting])
            rows = self._rows(chunks.dictionary.to_numpy(zero_copy_only=False).tolist())[chunks.indices.to_numpy()]
            sizes = self.sizes[rows]
            ends = np.cumsum(sizes)
            index = np.arange(int(ends[-1]), dtype=np.int64)
            index += np.repeat(self.starts[rows] - (ends - sizes), sizes)
            ids = self.ids[index]
            before = 0
            for (i, _), upto in zip(waiting, ends[np.cumsum(numbers) - 1].tolist()):
                parts[i].append(ids[before:upto])
                before = upto
            waiting.clear()

        for i, stretch in self._stretches(texts):
            waiting.append((i, stretch))
            size += len(stretch)
            if size >= BATCH_BYTES:
                settle()
                size = 0
        settle()
        for own in parts:
            yield own[0] if len(own) == 1 else np.concatenate([np.zeros(0, dtype=np.uint32), *own])

    def framed(self, ids: np.ndarray) -> np.ndarray:
        return np.concatenate([[self.begin], ids, [self.end]]).astype("<u4")

    def decode(self, ids: np.ndarray) -> str:
        """The text of any ids: control ids are silent, the marker put before the text goes, and of bytes that are no
        UTF-8 each becomes a replacement character."""
        first = 0
        while first < len(ids) and int(ids[first]) in self.silent:
            first += 1
        skip = int(first < len(ids) and int(ids[first]) in self.marked)
        inside = [first + int(i) for i in np.flatnonzero(self.lengths[ids[first:]] == 0)]  # control ids end a run of bytes
        if inside and inside[0] < len(ids) - len(inside):
            runs = zip([first, *inside], [*inside, len(ids)])
            return "".join(self._text(ids[a:b], skip if a == first else 0) for a, b in runs)
        return self._text(ids[first:], skip)

    def _text(self, ids: np.ndarray, skip: int) -> str:
        parts = []
        for start in range(0, len(ids), GATHER):
            some = ids[start : start + GATHER]
            lengths = self.lengths[some]
            ends = np.cumsum(lengths)
            index = np.arange(int(ends[-1]), dtype=np.int64)
            index += np.repeat(self.places[some] - (ends - lengths), lengths)
            parts.append(self.pool[index].tobytes())
        return b"".join(parts)[skip:].decode("utf-8", "each_byte")


def table(path: str) -> PieceTable:
    """A worker reads the model once."""
    return held(f"pieces {path}", lambda: PieceTable(path))


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``ids`` (little-endian 32-bit integers, begin and end ids included) and ``n_tokens`` of every text.

    One row per input row, repeated rows included; a null or empty text has the begin and end ids only; a null key stays
    null. Other columns are not read, whatever their names.
    """

    def prepare():
        model = table(path)

        def work(texts: list[str]) -> dict:
            ids = [model.framed(i) for i in model.encode(texts)]
            return {"ids": [i.tobytes() for i in ids], "n_tokens": [len(i) for i in ids]}

        return work

    return per_text(docs, [key], prepare, "ids binary, n_tokens bigint", text)


def decode_documents(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key`` and the ``text`` that its ids stand for; null ids give an empty text."""
    small_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = table(path)
        for batch in batches:
            texts = [model.decode(np.frombuffer(i or b"", dtype="<u4")) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(texts, type=pa.string())], names=[key, "text"])

    rows = encoded.select(F.col(f"`{key}`"), F.col(f"`{ids}`").alias("ids"))
    return rows.mapInArrow(run, f"`{key}` {rows.schema[0].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document, encoded and decoded in one pass.

    Null and empty texts have the begin and end ids and decode to nothing. Very long texts go stretch by stretch. Rows are
    never dropped or joined: repeated rows and null ids come out as they went in, an empty table gives no rows, and
    other columns are not read, whatever their names.
    """

    def prepare():
        model = table(path)

        def work(texts: list[str]) -> dict:
            out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for own in model.encode(texts):
                ids = model.framed(own)
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(ids.tobytes()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(model.decode(ids).encode()).hexdigest())
            return out

        return work

    return per_text(docs, ["doc_id"], prepare, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")
