"""Byte-level BPE: exact merges by backtracking over longest matches, decoding by an offset table.

Encoding. A text is cut at the tokenizer's special strings and by its split pattern. Each piece is walked from the
left with the longest vocabulary entry that starts there. One Aho-Corasick pass finds these entries: the automaton
holds the entries reversed and reads the piece backwards, so what it has matched at a position is the longest entry
that starts there. An entry may follow the one before it only if merging their bytes by rank would leave exactly these
two entries; that answer comes from a pair-compatibility table, filled as pairs are met. Where nothing fits, the walk
steps back; a position that failed once is never tried again, so the work is linear in the piece. All pieces of a batch
that are not in the bounded cache take their steps together, as arrays.

Decoding. All entries' bytes lie in one array; an id's place and length come from an offset table, and the bytes of
many ids are gathered at once.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioguard.llm.common import held, per_text

# Fixed value: the split pattern of byte-level BPE vocabularies of this family.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHED_WORDS = 350_000
CACHED_PIECES = 250_000
BATCH_CHARS = 4_000_000
GATHER_TOKENS = 1 << 20
MEMO_SLOTS = 1 << 21
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def byte_symbols() -> dict[str, int]:
    """The printable symbol that stands for each byte in the vocabulary file: itself where printable, else 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    symbols = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return symbols | {chr(256 + i): b for i, b in enumerate(rest)}


class IntTable:
    """Whole numbers by whole-number key, looked up as arrays; -1 where a key is absent."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(len(keys) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.values = np.full(1 << bits, -1, dtype=np.int32)
        left = np.arange(len(keys))
        slots = self._slot(keys)
        while len(left):
            free = self.keys[slots[left]] < 0
            self.keys[slots[left[free]]] = keys[left[free]]
            done = self.keys[slots[left]] == keys[left]
            self.values[slots[left[done]]] = values[left[done]]
            left = left[~done]
            slots[left] = (slots[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * SPREAD) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slots = self._slot(keys)
        found = self.keys[slots]
        out = np.where(found == keys, self.values[slots], -1)
        left = np.flatnonzero((found != keys) & (found >= 0))
        while len(left):
            slots[left] = (slots[left] + 1) & self.mask
            found = self.keys[slots[left]]
            hit = found == keys[left]
            out[left[hit]] = self.values[slots[left[hit]]]
            left = left[~hit & (found >= 0)]
        return out


class LongestStarts:
    """Aho-Corasick automaton over reversed entries, stepped for many pieces at a time."""

    def __init__(self, entries: Sequence[bytes]):
        children: dict[int, int] = {}
        ends, depth_of = [-1], [0]
        for number, entry in enumerate(entries):
            node = 0
            for byte in reversed(entry):
                key = node << 8 | byte
                nxt = children.get(key)
                if nxt is None:
                    nxt = children[key] = len(ends)
                    ends.append(-1)
                    depth_of.append(depth_of[node] + 1)
                node = nxt
            ends[node] = number
        keys = np.fromiter(children, dtype=np.int64, count=len(children))
        nodes = np.fromiter(children.values(), dtype=np.int64, count=len(children))
        self.edges = IntTable(keys, nodes)
        self.fail = np.zeros(len(ends), dtype=np.int32)
        self.out = np.array(ends, dtype=np.int32)
        depths = np.array(depth_of)[nodes]
        for depth in range(2, int(depths.max(initial=0)) + 1):
            level = depths == depth
            parents, bytes_, own = keys[level] >> 8, keys[level] & 255, nodes[level]
            self.fail[own] = self.step(self.fail[parents], bytes_)
            self.out[own] = np.where(self.out[own] >= 0, self.out[own], self.out[self.fail[own]])

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        state = state.astype(np.int64)
        nxt = self.edges.get(state << 8 | byte)
        left = np.flatnonzero((nxt < 0) & (state > 0))
        while len(left):
            state[left] = self.fail[state[left]]
            nxt[left] = self.edges.get(state[left] << 8 | byte[left])
            left = left[(nxt[left] < 0) & (state[left] > 0)]
        return np.maximum(nxt, 0)

    def longest(self, data: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        """For each place in ``data`` the longest entry that starts there; pieces come longest first."""
        best = np.full(len(data), -1, dtype=np.int32)
        state = np.zeros(len(first), dtype=np.int32)
        counts = np.searchsorted(-length, -np.arange(1, int(length[0]) + 1), side="right")
        for back, active in enumerate(counts.tolist(), start=1):
            at = first[:active] + length[:active] - back
            state[:active] = self.step(state[:active], data[at].astype(np.int64))
            best[at] = self.out[state[:active]]
        return best


class ByteBPE:
    """One vocabulary file. Entries are numbered single bytes first, then merges by rank."""

    def __init__(self, path: str, cached_words: int | None = None):
        self.cached_words = cached_words or CACHED_WORDS
        self.cached_pieces = min(CACHED_PIECES, self.cached_words)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, symbols = spec["model"], byte_symbols()
        if spec.get("normalizer") or model.get("ignore_merges") or model.get("byte_fallback"):
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        names = [s for s in model["vocab"] if len(s) == 1] + [a + b for a, b in merges]
        number = {s: i for i, s in enumerate(names)}
        if len(number) != len(names):
            raise ValueError(f"{path} makes one entry by two merges")
        entries = [bytes(symbols[c] for c in s) for s in names]
        left = np.array([number[a] for a, _ in merges], dtype=np.int64)
        right = np.array([number[b] for _, b in merges], dtype=np.int64)
        singles = np.arange(len(names) - len(merges))
        self.n = len(names)
        self.merged = IntTable(left << 32 | right, np.arange(len(singles), self.n))
        self.head = np.concatenate([singles, left])
        self.tail = np.concatenate([singles, right])
        self.length = np.array([len(e) for e in entries], dtype=np.int64)
        self.starts = LongestStarts(entries)
        by_bytes = {e: i for i, e in enumerate(entries)}
        self.prefix = np.full(self.n, -1, dtype=np.int32)
        for i, e in enumerate(entries):
            self.prefix[i] = next((by_bytes[e[:k]] for k in range(len(e) - 1, 0, -1) if e[:k] in by_bytes), -1)
        self.memo_key = np.full(MEMO_SLOTS, -1, dtype=np.int64)
        self.memo_fits = np.zeros(MEMO_SLOTS, dtype=bool)
        self.ids = np.array([model["vocab"][s] for s in names], dtype="<u4")

        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.pieces = regex.compile(PIECES)
        self.odd_space = regex.compile(r" \s|\s ")
        self.white = regex.compile(r"\s")
        self.words: dict[str, bytes] = {}
        self.firsts: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}

        place: dict[int, bytes] = dict(zip(self.ids.tolist(), entries)) | {i: s.encode() for s, i in self.special.items()}
        self.lengths = np.zeros(max(place) + 1, dtype=np.int64)
        self.lengths[list(place)] = [len(b) for b in place.values()]
        self.places = np.cumsum(self.lengths) - self.lengths
        self.pool = np.frombuffer(b"".join(place.get(i, b"") for i in range(len(self.lengths))), dtype=np.uint8)
        self.decimals = [str(i) for i in range(len(self.lengths))]

    # -- pairs

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging by rank leaves ``left`` and ``right`` side by side, from the table where it has them."""
        key = left.astype(np.int64) << 32 | right
        slot = ((key.astype(np.uint64) * SPREAD) >> np.uint64(64 - MEMO_SLOTS.bit_length() + 1)).astype(np.int64)
        fits = self.memo_fits[slot]
        new = np.flatnonzero(self.memo_key[slot] != key)
        if len(new):
            fits[new] = self._survives(left[new], right[new])
            self.memo_key[slot[new]] = key[new]
            self.memo_fits[slot[new]] = fits[new]
        return fits

    def _survives(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Undo the merges of both entries from the latest on. If the two entries that then touch at the border could
        have been merged before what is undone so far was made, the border would not have survived."""
        a, b = left.astype(np.int64), right.astype(np.int64)
        before = np.full(len(a), self.n, dtype=np.int64)
        fits = np.ones(len(a), dtype=bool)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            merged = self.merged.get(x << 32 | y)
            broken = (merged >= 0) & (merged < before[live])
            fits[live[broken]] = False
            can_left, can_right = self.tail[x] != x, self.head[y] != y
            undo_left = can_left & ((x > y) | ~can_right)
            undo_right = can_right & ~undo_left
            before[live] = np.where(undo_left, x, y + 1)
            a[live] = np.where(undo_left, self.tail[x], x)
            b[live] = np.where(undo_right, self.head[y], y)
            live = live[~broken & (undo_left | undo_right)]
        return fits

    # -- pieces

    def encode_pieces(self, pieces: Sequence[bytes]) -> list[bytes]:
        """Ids of each piece, as little-endian 32-bit integers; a piece has at least one byte."""
        if not pieces:
            return []
        length = np.array([len(p) for p in pieces], dtype=np.int64)
        order = np.argsort(-length, kind="stable")
        length = length[order]
        first = np.cumsum(length) - length
        data = np.frombuffer(b"".join([pieces[i] for i in order.tolist()]), dtype=np.uint8)
        best = self.starts.longest(data, first, length)
        chosen = np.zeros(len(data), dtype=np.int32)
        dead = np.zeros(len(data) + 1, dtype=bool)
        at = first.copy()
        end = first + length
        count = np.zeros(len(pieces), dtype=np.int64)
        entry = best[first].astype(np.int64)
        live = np.arange(len(pieces))
        while len(live):
            cand, here, n = entry[live], at[live], count[live]
            stuck = cand < 0
            back = live[stuck]
            if len(back):
                dead[at[back]] = True
                count[back] -= 1
                last = chosen[first[back] + count[back]]
                at[back] -= self.length[last]
                entry[back] = self.prefix[last]
            go = np.flatnonzero(~stuck)
            piece, cand, here, n = live[go], cand[go], here[go], n[go]
            after = here + self.length[cand]
            ok = (after == end[piece]) | ~dead[after]
            check = np.flatnonzero(ok & (n > 0))
            ok[check] = self.compatible(chosen[first[piece[check]] + n[check] - 1], cand[check])
            entry[piece[~ok]] = self.prefix[cand[~ok]]
            took, after = piece[ok], after[ok]
            chosen[first[took] + n[ok]] = cand[ok]
            count[took] += 1
            at[took] = after
            more = after < end[took]
            entry[took[more]] = best[after[more]]
            done = np.zeros(len(live), dtype=bool)
            done[go[ok][~more]] = True
            live = live[~done]
        raw = self.ids[chosen].tobytes()
        out: list[bytes] = [b""] * len(pieces)
        for i, start, stop in zip(order.tolist(), (first * 4).tolist(), ((first + count) * 4).tolist()):
            out[i] = raw[start:stop]
        return out

    # -- texts

    def _cut_words(self, text: str) -> list[str]:
        """``text`` cut before single spaces that stand between other characters, the space left out.

        The pattern starts a piece at each such space, so the cuts change no piece, and words repeat far more
        often than texts. Any other white space stays inside a word.
        """
        words = text.split(" ")
        if self.odd_space.search(text) is None:
            return words
        joined: list[str] = []
        for word in words:
            if joined and not (word and joined[-1] and not word[0].isspace() and not joined[-1][-1].isspace()):
                joined[-1] += " " + word
            else:
                joined.append(word)
        return joined

    def _learn(self, wanted: set[str], into: dict[str, bytes], space: str) -> None:
        """Put the ids of words into ``into``, each word with ``space`` before it."""
        new = [w for w in wanted if w not in into]
        if not new:
            return
        if len(into) + len(new) > self.cached_words:
            into.clear()
            new = list(wanted)
        plain, odd = [], []
        for word in new:
            (odd if not word or self.white.search(word) else plain).append(word)
        pieces: list[list[str]] = []
        if plain:  # a line feed is a piece of its own between words without white space
            row: list[str] = []
            for piece in self.pieces.findall(("\n" + space).join(["", *plain])):
                if piece == "\n":
                    pieces.append(row := [])
                else:
                    row.append(piece)
        pieces += [self.pieces.findall(space + word) for word in odd]
        distinct = list({p for row in pieces for p in row if p not in self.known})
        if len(self.known) + len(distinct) > self.cached_pieces:
            self.known.clear()
            distinct = list({p for row in pieces for p in row})
        known = self.known
        known.update(zip(distinct, self.encode_pieces([p.encode("utf-8") for p in distinct])))
        for word, row in zip([*plain, *odd], pieces):
            into[word] = known[row[0]] if len(row) == 1 else b"".join([known[p] for p in row])

    def _encode_ordinary(self, texts: Sequence[str]) -> list[bytes]:
        cut = [self._cut_words(t) if t else [""] for t in texts]
        self._learn({words[0] for words in cut if words[0]}, self.firsts, "")
        wanted: set[str] = set()
        for words in cut:
            wanted.update(words[1:])
        self._learn(wanted, self.words, " ")
        get = self.words.__getitem__
        return [(self.firsts[w[0]] if w[0] else b"") + b"".join(map(get, w[1:])) for w in cut]

    def encode(self, texts: Sequence[str]) -> Iterator[bytes]:
        """Ids of each text, in order, as little-endian 32-bit integers."""
        start = 0
        while start < len(texts):
            stop, size = start, 0
            while stop < len(texts) and size < BATCH_CHARS:
                size += len(texts[stop])
                stop += 1
            parts: list[str] = []
            shape: list[list[str]] = []
            for text in texts[start:stop]:
                shape.append(self.cut.split(text) if self.cut is not None and "<" in text else [text])
                parts += shape[-1][::2]
            coded = iter(self._encode_ordinary(parts))
            for row in shape:
                yield b"".join(
                    next(coded) if i % 2 == 0 else np.array([self.special[s]], dtype="<u4").tobytes()
                    for i, s in enumerate(row))
            start = stop

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a run of ids."""
        parts = []
        for start in range(0, len(ids), GATHER_TOKENS):
            some = ids[start : start + GATHER_TOKENS]
            lengths = self.lengths[some]
            ends = np.cumsum(lengths)
            index = np.arange(int(ends[-1]), dtype=np.int64)
            index += np.repeat(self.places[some] - (ends - lengths), lengths)
            parts.append(self.pool[index].tobytes())
        return b"".join(parts)


def vocabulary(path: str, cached_words: int | None = None) -> ByteBPE:
    """A worker reads the file once."""
    return held(f"bytes {cached_words} {path}", lambda: ByteBPE(path, cached_words))


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``ids`` (little-endian 32-bit integers) and ``n_tokens`` of every text.

    One row per input row, repeated rows included; a null or empty text has no ids; a null key stays null.
    """

    def prepare():
        bpe = vocabulary(path)

        def work(texts: list[str]) -> dict:
            ids = list(bpe.encode(texts))
            return {"ids": ids, "n_tokens": [len(i) // 4 for i in ids]}

        return work

    return per_text(docs, [key], prepare, "ids binary, n_tokens bigint", text)


def decode_documents(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key`` and the ``text`` that its ids stand for; bytes that are no UTF-8 become replacement characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            coded = batch.column("ids").to_pylist()
            texts = [bpe.decode(np.frombuffer(i or b"", dtype="<u4")).decode("utf-8", "replace") for i in coded]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(texts, type=pa.string())], names=[key, "text"])

    rows = encoded.select(F.col(f"`{key}`"), F.col(f"`{ids}`").alias("ids"))
    return rows.mapInArrow(run, f"`{key}` {rows.schema[0].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, path: str, cached_words: int | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document, encoded and decoded in one pass.

    ``cached_words`` bounds what a worker keeps, where memory is short; it changes no result.

    Null and empty texts have no tokens and the digests of nothing. Rows are never dropped or joined: repeated
    rows and null ids come out as they went in.
    """

    def prepare():
        bpe = vocabulary(path, cached_words)
        shown = bpe.decimals.__getitem__

        def work(texts: list[str]) -> dict:
            out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for raw in bpe.encode(texts):
                ids = np.frombuffer(raw, dtype="<u4")
                back = bpe.decode(ids).decode("utf-8", "replace")
                decimals = ",".join(map(shown, ids.tolist()))
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(decimals.encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(back.encode("utf-8")).hexdigest())
            return out

        return work

    return per_text(docs, ["doc_id"], prepare, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")
