"""Byte-level BPE by a segment tree over the ranks of adjacent pairs.

The tree's leaf at a symbol's place holds the rank of the pair that starts there; inner nodes hold the least rank with the
leftmost place. The root so names the next merge, and a merge changes three leaves, each with a logarithmic path to the
root. Words of like length are merged side by side, one tree in each row of an array; long ones have a tree of their own.
Ids of words are remembered, as few words make up most of a text.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import as_bytes, chunks, release

# fixed values of byte-level BPE: the pattern that splits a text into words
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
REMEMBERED = 150_000  # words whose ids a worker keeps at most
NONE = 1 << 30  # rank of a pair that doesn't merge
SIDE_BY_SIDE = 256  # words of up to so many bytes share an array


def byte_characters() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files: printable Latin-1 stands for itself, others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one vocabulary, given as the text of its JSON file."""

    def __init__(self, file: str):
        j = json.loads(file)
        to_byte = byte_characters()
        vocab = j["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in j.get("added_tokens", [])}
        own = {t: i for t, i in vocab.items() if t not in self.special}
        self.bytes = {i: bytes(to_byte[c] for c in t) for t, i in own.items()}
        self.bytes |= {i: t.encode() for t, i in self.special.items()}
        self.of_byte = np.array([vocab[c] for c, _ in sorted(to_byte.items(), key=lambda x: x[1])], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in j["model"]["merges"]]
        self.made = np.array([vocab[a + b] for a, b in merges] or [0], np.int64)
        self._hash({(vocab[a] << 20) | vocab[b]: r for r, (a, b) in reversed([*enumerate(merges)])})
        self.words = regex.compile(PATTERN)
        self.cut = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.known: dict[str, bytes] = {}

    def _hash(self, ranks: dict[int, int]) -> None:
        """Open addressing, filled and read array-wise."""
        self.bits = max(4, (4 * len(ranks) + 1).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int64)
        key = np.fromiter(ranks.keys(), np.int64, len(ranks))
        rank, slot = np.fromiter(ranks.values(), np.int64, len(ranks)), self._slot(key)
        while len(key):
            free = self.keys[slot] == -1
            at, first = np.unique(slot[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.keys[at], self.ranks[at] = key[put], rank[put]
            left = np.ones(len(key), bool)
            left[put] = False
            key, rank, slot = key[left], rank[left], (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 20) | b
        slot = self._slot(key)
        there = self.keys[slot]
        out = np.where(there == key, self.ranks[slot], NONE)
        open_ = np.flatnonzero((there != key) & (there != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot[open_]]
            hit = there == key[open_]
            out[open_[hit]] = self.ranks[slot[open_[hit]]]
            open_ = open_[~hit & (there != -1)]
        return out

    def merge_rows(self, words: list[bytes], width: int) -> list[bytes]:
        """Ids of words of up to width bytes, a power of two, as packed unsigned 32-bit integers."""
        n, levels = len(words), width.bit_length() - 1
        lengths = np.array([len(w) for w in words])
        text = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        place = np.arange(width)
        live = place < lengths[:, None]
        ids = np.where(live, self.of_byte[text], -1)
        after = np.broadcast_to(place + 1, (n, width)).copy()
        before = np.broadcast_to(place - 1, (n, width)).copy()
        tree = np.full((n, 2 * width), NONE << 20, np.int64)
        pair = live[:, 1:]
        first = np.full((n, width), NONE, np.int64)
        first[:, :-1][pair] = self.rank(ids[:, :-1][pair], ids[:, 1:][pair])
        tree[:, width:] = (first << 20) | place
        for level in range(levels - 1, -1, -1):
            at = 1 << level
            tree[:, at : 2 * at] = np.minimum(tree[:, 2 * at : 4 * at : 2], tree[:, 2 * at + 1 : 4 * at : 2])
        active = np.flatnonzero((tree[:, 1] >> 20) < NONE)
        while len(active):
            root = tree[active, 1]
            at = root & 0xFFFFF
            gone = after[active, at]
            ids[active, at] = self.made[root >> 20]
            ids[active, gone] = -1
            nxt = after[active, gone]
            after[active, at] = nxt
            has_next = nxt < lengths[active]
            before[active[has_next], nxt[has_next]] = at[has_next]
            prev = before[active, at]
            has_prev = prev >= 0
            mine, right, left = np.full((3, len(active)), NONE, np.int64)
            now = ids[active, at]
            mine[has_next] = self.rank(now[has_next], ids[active[has_next], nxt[has_next]])
            left[has_prev] = self.rank(ids[active[has_prev], prev[has_prev]], now[has_prev])
            row = np.concatenate([active, active, active[has_prev]])
            leaf = np.concatenate([at, gone, prev[has_prev]])
            node = leaf + width
            tree[row, node] = (np.concatenate([mine, right, left[has_prev]]) << 20) | leaf
            for _ in range(levels):
                node >>= 1
                tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
            active = active[(tree[active, 1] >> 20) < NONE]
        kept = ids >= 0
        flat = ids[kept].astype("<u4").tobytes()
        ends = np.cumsum(kept.sum(1)) * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def merge_long(self, word: bytes) -> bytes:
        """The same for one word of any length."""
        n = len(word)
        width = 1 << (n - 1).bit_length()
        none = (NONE, 0)
        ids, after, before = self.of_byte[np.frombuffer(word, np.uint8)], list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = self.rank(ids[:-1], ids[1:]).tolist() if n > 1 else []
        ids = ids.tolist()
        tree = [none] * (2 * width)
        for i, r in enumerate(ranks):
            tree[width + i] = (r, i)
        for i in range(width - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(i: int, r: int) -> None:
            k = width + i
            tree[k] = (r, i)
            while k > 1:
                k >>= 1
                tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def rank_of(a: int, b: int) -> int:
            key = (a << 20) | b
            slot = ((key * 0x9E3779B97F4A7C15) & (2**64 - 1)) >> (64 - self.bits)
            while (there := self.keys[slot]) != key:
                if there == -1:
                    return NONE
                slot = (slot + 1) & ((1 << self.bits) - 1)
            return int(self.ranks[slot])

        while tree[1][0] < NONE:
            rank, i = tree[1]
            gone = after[i]
            ids[i], ids[gone], after[i] = int(self.made[rank]), -1, after[gone]
            nxt = after[i]
            put(gone, NONE)
            if nxt < n:
                before[nxt] = i
                put(i, rank_of(ids[i], ids[nxt]))
            else:
                put(i, NONE)
            if before[i] >= 0:
                put(before[i], rank_of(ids[before[i]], ids[i]))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def learn(self, words: list[str]) -> None:
        by_width: dict[int, list[str]] = {}
        raw = {w: w.encode() for w in words}
        for w, b in raw.items():
            if len(b) > SIDE_BY_SIDE:
                self.known[w] = self.merge_long(b)
            else:
                by_width.setdefault(max(2, 1 << (len(b) - 1).bit_length()), []).append(w)
        for width, group in by_width.items():
            step = max(1, (1 << 18) // width)
            for i in range(0, len(group), step):
                part = group[i : i + step]
                self.known.update(zip(part, self.merge_rows([raw[w] for w in part], width), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as packed little-endian unsigned 32-bit integers; special tokens in a text become their ids."""
        plans = []
        for text in texts:
            if self.cut is not None and any(t in text for t in self.special):
                plan, at = [], 0
                for m in self.cut.finditer(text):
                    plan += [self.words.findall(text[at : m.start()]), self.special[m[0]]]
                    at = m.end()
                plans.append([*plan, self.words.findall(text[at:])])
            else:
                plans.append([self.words.findall(text)])
        seen: set[str] = set()
        for plan in plans:
            for part in plan:
                if not isinstance(part, int):
                    seen.update(part)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        self.learn([w for w in seen if w not in self.known])
        known = self.known.__getitem__
        return [b"".join(np.uint32(p).tobytes() if isinstance(p, int) else b"".join(map(known, p)) for p in plan) for plan in plans]

    def decode(self, ids: bytes) -> str:
        """Text of packed ids; bytes that aren't UTF-8 become replacement characters, unknown ids nothing."""
        get = self.bytes
        return b"".join([get.get(i, b"") for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


@functools.lru_cache(4)
def codec(file: str) -> Codec:
    """One for each vocabulary in a process, so that what it remembers outlives a task."""
    return Codec(file)


def _mapped(docs: DataFrame, path: str, columns: dict[str, str], run, types: dict[str, pa.DataType], out: str) -> DataFrame:
    with open(path, encoding="utf-8") as f:  # on the driver; executors get its text
        file = docs.sparkSession.sparkContext.broadcast(f.read())
    mine = docs.select(*[F.col(c).alias(n) for n, c in columns.items()])
    id_type = mine.schema[0].dataType.simpleString()

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(file.value)
        for batch in source:
            _, offsets = as_bytes(batch.column(1)) if pa.types.is_string(batch.column(1).type) or pa.types.is_large_string(batch.column(1).type) else (None, None)
            pieces = chunks(offsets, 1 << 18) if offsets is not None else [(0, batch.num_rows)]
            for a, b in pieces:
                part = batch.slice(a, b - a)
                results = run(own, part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(r, t) for r, t in zip(results, types.values(), strict=True)]], names=["doc_id", *types])
            release()

    return mine.mapInArrow(batches, f"doc_id {id_type}, {out}")


def encode(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and ids (array of int) of each whole text; null and empty texts have no ids. Rows that repeat stay."""
    return _mapped(docs, path, {"doc_id": doc_id, "text": text}, lambda own, col: [[np.frombuffer(x, "<u4").astype(np.int32) for x in own.encode([t or "" for t in col.to_pylist()])]], {"ids": pa.list_(pa.int32())}, "ids array<int>")


def decode(coded: DataFrame, path: str, ids: str = "ids", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and text of each row of ids; null ids give an empty text, null elements and unknown ids nothing."""
    return _mapped(coded, path, {"doc_id": doc_id, "ids": ids}, lambda own, col: [[own.decode(np.array([i for i in x or [] if i is not None], "<u4").tobytes()) for x in col.to_pylist()]], {"text": pa.string()}, "text string")


def round_trip(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of what encode gives and of what decode makes of that, in one pass."""

    def run(own: Codec, col: pa.Array):
        coded = own.encode([t or "" for t in col.to_pylist()])
        sha = lambda b: hashlib.sha256(b).hexdigest()
        return [len(x) // 4 for x in coded], [sha(x) for x in coded], [sha(own.decode(x).encode()) for x in coded]

    return _mapped(docs, path, {"doc_id": doc_id, "text": text}, run, {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}, "n_tokens long, ids_sha256 string, decoded_sha256 string")
