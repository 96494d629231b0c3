"""Language-model scores by a causal self-attention model over subword ids, trained in numpy.

Each text is tokenised once into subwords of a fixed vocabulary; the ids are stored and read by every later step. A text is scored in
overlapping windows: each block of BLOCK subwords sees itself, causally, and the block before it, so every token is scored once.
Attention tells the group of classes of each next subword from what stands before (lm_model). Inside the class, the word's exact
frequency in all training text counts; what absolute discounting takes from the frequencies goes to attention's chance of the word's
further subwords and of its end, so words never seen have a chance as well. A copy part then gives a share of the chance, growing
with the text read so far, to the words read so far. All parts are causal and add up to one for each token, hence the chances of
all texts add up to no more than one.

Counts of words are exact: a task sends each distinct word's hash once, with its count and with the documents that hold it, to which
the word's count then returns. Words that are frequent in a constant share of the training text do without their documents,
as their counts are broadcast; which these are changes no result.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lm_model as M
from . import wordhash as H
from .bpe import PATTERN, codec
from .toxicity import held_out
from .util import as_bytes, binary_rows, chunks, partitions, stored

END = 50256  # id of the end of a text in the vocabulary
FREQUENT = 50_000  # words whose counts are broadcast at most
SAMPLE = 64  # one of so many training texts tells which words are frequent
ROUNDS = 5  # attention learns from every training block, each in one of the rounds
SHARD_TOKENS = 4_000_000  # subwords that one shard of a round has, about
RATE = 0.03
COPIED, COPY_RISE = 0.08, 20  # share of the chance for words read before, and the words read at which it is half of that
REMEMBERED = 1_500_000  # words whose ids a worker keeps at most
FLUSH_WORDS = 3_000_000
LOG10 = math.log(10)


def opening_ids(of_id: dict[int, bytes]) -> np.ndarray:
    """Which ids open a word; END counts as one."""
    opens = np.zeros(65536, bool)
    for i, b in of_id.items():
        opens[i] = b.startswith(b" ")
    opens[END] = True
    return opens


class Lexicon:
    """Subword ids of words, found by the words' hashes: open addressing, read and filled array-wise."""

    def __init__(self, file: str):
        own = codec(file)
        ranks = {b: i for i, b in own.bytes.items() if i not in own.special.values()}
        self.library = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.opens = opening_ids(own.bytes)
        self.clear()

    def clear(self) -> None:
        self.ids, self.starts, self.names = np.zeros(0, np.uint16), np.zeros(1, np.int64), np.zeros(0, np.uint64)
        self._resize(1 << 21)

    def _resize(self, size: int) -> None:
        self.slots, self.mask = np.full(size, -1, np.int32), np.uint64(size - 1)
        self._place(np.arange(len(self.names), dtype=np.int32))

    def _place(self, number: np.ndarray) -> None:
        slot = self.names[number] & self.mask
        while len(number):
            free = np.flatnonzero(self.slots[slot] < 0)
            at, one = np.unique(slot[free], return_index=True)
            self.slots[at] = number[free[one]]
            left = np.ones(len(number), bool)
            left[free[one]] = False
            number, slot = number[left], (slot[left] + np.uint64(1)) & self.mask

    def find(self, names: np.ndarray) -> np.ndarray:
        """Number of each word, -1 if it isn't known."""
        slot = names & self.mask
        out = self.slots[slot]
        if len(self.names):
            open_ = np.flatnonzero((out >= 0) & (self.names[out] != names))
            while len(open_):
                slot[open_] = (slot[open_] + np.uint64(1)) & self.mask
                out[open_] = self.slots[slot[open_]]
                open_ = open_[(out[open_] >= 0) & (self.names[out[open_]] != names[open_])]
        return out

    def add(self, names: np.ndarray, words: list[str]) -> None:
        """New words with distinct hashes."""
        ids = np.array(self.library.encode_ordinary(" " + " ".join(words)), np.int64)
        begin = np.flatnonzero(self.opens[ids])
        if len(begin) == len(words):
            sizes = np.diff(np.append(begin, len(ids)))
        else:  # unusual white space at a word's end or beginning joins the space between words
            each = [self.library.encode_ordinary(" " + w) for w in words]
            ids, sizes = np.array([i for x in each for i in x], np.int64), np.array([len(x) for x in each])
        first = len(self.names)
        self.ids = np.concatenate([self.ids, ids.astype(np.uint16)])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        self.names = np.concatenate([self.names, names])
        if 2 * len(self.names) > len(self.slots):
            self._resize(1 << (4 * len(self.names)).bit_length())
        else:
            self._place(np.arange(first, len(self.names), dtype=np.int32))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Subword ids of texts that lie end to end, each with END behind it; where each text's ids begin (n+1 places); and its
        number of tokens."""
        low = H.LOWER[data]
        start, end, begin = H.words(low, offsets)
        names = H.spans(H.running(low), start, end)
        if len(self.names) > REMEMBERED:
            self.clear()
        known = self.find(names)
        new = np.flatnonzero(known < 0)
        if len(new):
            distinct, first = np.unique(names[new], return_index=True)
            raw, first = low.tobytes(), new[first]
            self.add(distinct, [raw[a:b].decode() for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)])
            known[new] = self.find(names[new])
        n, text = np.diff(self.starts)[known], np.repeat(np.arange(len(offsets) - 1), np.diff(begin))
        ends = np.cumsum(np.bincount(text, n, len(offsets) - 1).astype(np.int64) + 1)
        out = np.full(int(ends[-1]) if len(ends) else 0, END, np.uint16)
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(np.cumsum(n) - n + text, n) + inside] = self.ids[np.repeat(self.starts[known], n) + inside]  # an END stands behind each text before
        return out, np.concatenate([[0], ends]), np.diff(begin) + 1


@functools.lru_cache(1)
def lexicon_of(file: str) -> Lexicon:
    """One in a process, so that what it remembers outlives a task."""
    return Lexicon(file)


def _tokenised(file):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = lexicon_of(file.value)
        for batch in batches:
            data, offsets = as_bytes(batch.column("text"))
            for a, b in chunks(offsets, 2 << 20):
                ids, ends, tokens = lexicon.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), part.column("row"), pa.array(tokens), binary_rows(ids, ends[1:]), pa.array(_digests(ids, ends).view(np.int64))], names=["doc_id", "held_out", "row", "n_tokens", "ids", "digest"])

    return run


def _joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = as_bytes(column)
    return np.frombuffer(data.tobytes(), np.uint16), offsets // 2


ID_CODES = H.mixed(np.arange(1, 65537).astype(np.uint64) * H.BASE) | np.uint64(1)


def _sums(ids: np.ndarray) -> np.ndarray:
    return H.running(ids, ID_CODES)


def _digests(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return H.spans(_sums(ids), offsets[:-1], offsets[1:])


def _digests_of(batch: pa.RecordBatch, every: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The texts' hashes, worked out if they aren't stored with the ids."""
    return batch.column("digest").to_numpy().view(np.uint64) if "digest" in batch.schema.names else _digests(every, offsets)


def words(ids: np.ndarray, offsets: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First place, hash and text of each token (word or end): a word runs from a subword that opens one to the next."""
    first = np.flatnonzero(opens[ids])
    return first, H.spans(_sums(ids), first, np.append(first[1:], len(ids))), np.searchsorted(offsets, first, side="right") - 1


_COUNTS = pa.schema([("part", pa.int32()), ("names", pa.binary()), ("counts", pa.binary()), ("classes", pa.binary()), ("n_docs", pa.binary()), ("docs", pa.binary())])
_COUNTS_SQL = "part int, names binary, counts binary, classes binary, n_docs binary, docs binary"


def _counted(parts: int, opens, frequent, class_of):
    """Distinct words of a task's texts by part: hash, count in training texts, class, and the texts (rows) with a rare one."""

    def flush(held) -> Iterator[pa.RecordBatch]:
        names, rows, train, classes = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(names, kind="stable")  # a text's words stay side by side
        names, rows, train, classes = names[order], rows[order], train[order], classes[order]
        new_name = np.concatenate([[True], names[1:] != names[:-1]])
        new_pair = new_name | np.concatenate([[True], rows[1:] != rows[:-1]])
        pair_at, name_at = np.flatnonzero(new_pair), np.flatnonzero(new_name)
        counts = np.add.reduceat(train.astype(np.int64), name_at).astype(np.uint32)
        rare = ~np.isin(names[name_at], frequent.value)
        n_docs = np.where(rare, np.add.reduceat(new_pair.astype(np.int64), name_at), 0).astype(np.uint32)
        rare_pair = rare[np.cumsum(new_name)[pair_at] - 1]
        docs, names, classes = rows[pair_at][rare_pair], names[name_at], classes[name_at]
        part = (names >> np.uint64(32)) % np.uint64(parts)
        by_part = np.argsort(part, kind="stable")
        pair_part = np.repeat(part, n_docs)
        pairs = np.argsort(pair_part, kind="stable")
        which, begin = np.unique(part[by_part], return_index=True)
        ends = np.append(begin[1:], len(part))
        pair_ends = np.searchsorted(pair_part[pairs], which, side="right")
        yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), *[binary_rows(x[by_part], ends) for x in (names, counts, classes, n_docs)], binary_rows(docs[pairs], pair_ends)], schema=_COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            ids, offsets = _joined(batch.column("ids"))
            row, train = batch.column("row").to_numpy(), ~np.asarray(batch.column("held_out").to_pylist(), bool)
            for a, b in chunks(offsets, 1 << 20):
                part = ids[offsets[a] : offsets[b]]
                first, names, of = words(part, offsets[a : b + 1] - offsets[a], opens.value)
                held.append((names, row[a:b][of], train[a:b][of], class_of.value[part[first]].astype(np.uint16)))
                n += len(names)
                if n > FLUSH_WORDS:
                    yield from flush(held)
                    held, n = [], 0
        if n:
            yield from flush(held)

    return run


def _summed(parts: int, frequent):
    """A part's exact counts: those of each text's rare words (blobs dealt by row), those of the frequent, and the part's sums: words,
    distinct ones, those that occur once and twice, and words and distinct ones by class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols = [[], [], [], [], []]
        for batch in batches:
            for c, (k, kind) in zip(cols, (("names", np.uint64), ("counts", np.uint32), ("classes", np.uint16), ("n_docs", np.uint32), ("docs", np.int64)), strict=True):
                c += [np.frombuffer(x.as_buffer(), kind) for x in batch.column(k)]
        if not cols[0]:
            return
        names, counts, classes, n_docs, docs = (np.concatenate(c) for c in cols)
        unique, one, index = np.unique(names, return_index=True, return_inverse=True)
        total, classes = np.bincount(index, counts).astype(np.int64), classes[one]
        word = np.repeat(index, n_docs)
        target = docs % parts
        order = np.lexsort((docs, target))  # equal rows side by side take little room
        which, begin = np.unique(target[order], return_index=True)
        ends = np.append(begin[1:], len(order)) if len(which) else np.zeros(0, np.int64)
        docs, word = docs[order], word[order]
        often = np.isin(unique, frequent.value)
        n = len(which)
        row = lambda x: pa.array([*[None] * n, x], pa.binary())
        sums = [int(total.sum()), int((total > 0).sum()), int((total == 1).sum()), int((total == 2).sum())]
        by_class = [np.bincount(classes, total, M.CLASSES).astype(np.int64).tolist(), np.bincount(classes[total > 0], minlength=M.CLASSES).tolist()]
        yield pa.RecordBatch.from_arrays([
            pa.array([*which.tolist(), -1], pa.int32()), *[pa.concat_arrays([binary_rows(x, ends), row(None)[n:]]) for x in (docs, unique[word], total[word])],
            row(unique[often].tobytes()), row(total[often].tobytes()), *[pa.array([*[None] * n, x], pa.list_(pa.int64())) for x in (sums, *by_class)]],
            names=["part", "docs", "names", "counts", "often", "often_counts", "sums", "class_words", "class_distinct"])

    return run


_SUMMED_SQL = "part int, docs binary, names binary, counts binary, often binary, often_counts binary, sums array<long>, class_words array<long>, class_distinct array<long>"


def _by_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rare words of each text with their counts in all training text."""
    docs, names, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for batch in batches:
        docs += [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("docs")]
        names += [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("names")]
        counts += [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("counts")]
    docs, names, counts = (np.concatenate(x) for x in (docs, names, counts))
    order = np.argsort(docs, kind="stable")
    own, n = np.unique(docs, return_counts=True)
    ends = np.cumsum(n)
    yield pa.RecordBatch.from_arrays([pa.array(own), binary_rows(names[order], ends), binary_rows(counts[order], ends)], names=["row", "names", "counts"])


def _some_words(opens):
    """Counts of words in one of SAMPLE texts, by the texts' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every, own = _joined(batch.column("ids"))
            digests = _digests_of(batch, every, own)
            for a, b in chunks(own, 1 << 20):
                ids, offsets = every[own[a] : own[b]], own[a : b + 1] - own[a]
                drawn = H.mixed(digests[a:b]) % np.uint64(SAMPLE) == 0
                size = np.diff(offsets)
                ids, offsets = ids[np.repeat(drawn, size)], np.concatenate([[0], np.cumsum(size[drawn])])
                if len(ids):
                    names, n = np.unique(words(ids, offsets, opens.value)[1], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(n)], names=["name", "n"])

    return run


def _id_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(65536, np.int64)
    for batch in batches:
        total += np.bincount(_joined(batch.column("ids"))[0], minlength=65536)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["id", "n"])


def _pairs(class_of):
    """Counts of neighbouring classes; the end stands before each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(M.CLASSES * M.CLASSES, np.int64)
        for batch in batches:
            ids, offsets = _joined(batch.column("ids"))
            for a, b in chunks(offsets, 1 << 20):
                c = class_of.value[ids[offsets[a] : offsets[b]]].astype(np.int64)
                before = np.concatenate([[M.END_CLASS], c[:-1]])
                before[offsets[a:b] - offsets[a]] = M.END_CLASS  # no text is empty: each has its end
                total += np.bincount(before * M.CLASSES + c, minlength=M.CLASSES * M.CLASSES)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array((seen // M.CLASSES).astype(np.int32)), pa.array((seen % M.CLASSES).astype(np.int32)), pa.array(total[seen])], names=["a", "b", "n"])

    return run


def _segments(class_of, round_: int, shards: int):
    """What a round trains on: all segments of texts, or with more rounds its part of them, drawn and dealt to shards by a hash of the text and of the
    segment's number in it. A shard's classes, where its segments end, and the class before each."""
    low, high = (np.uint64((1 << 24) * i // ROUNDS) for i in (round_, round_ + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every, own = _joined(batch.column("ids"))
            digests = _digests_of(batch, every, own)
            for a, b in chunks(own, 1 << 20):
                ids, offsets = every[own[a] : own[b]], own[a : b + 1] - own[a]
                start, end, text, number = M.segments(offsets)
                draw = H.mixed(digests[a:b][text] * H.BASE + number.astype(np.uint64))
                place = draw >> np.uint64(40)
                take = np.flatnonzero((place >= low) & (place < high))
                shard = ((draw[take] & np.uint64(0xFFFFFFFF)) % np.uint64(shards)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                take, (which, begin) = take[order], np.unique(shard[order], return_index=True)
                if not len(which):
                    continue
                n = end[take] - start[take]
                classes = class_of.value
                lead = np.where(start[take] > offsets[text[take]], classes[ids[start[take] - 1]], np.where(number[take] > 0, M.END_CLASS, -1)).astype(np.int16)
                flat = classes[ids[np.repeat(start[take] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]].astype(np.int16)
                ends = np.append(begin[1:], len(take))
                yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), binary_rows(flat, np.cumsum(n)[ends - 1]), binary_rows(n.astype(np.int16), ends), binary_rows(lead, ends)], names=["shard", "classes", "sizes", "leads"])

    return run


_SEGMENTS_SQL = "shard int, classes binary, sizes binary, leads binary"


def _trained(weights, tables, rate: float):
    """Weights of each shard of a task, which holds a few shards of about SHARD_TOKENS subwords."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, list] = {}
        for batch in batches:
            for shard, *x in zip(batch.column("shard").to_pylist(), *[batch.column(c) for c in ("classes", "sizes", "leads")], strict=True):
                got.setdefault(shard, []).append([np.frombuffer(y.as_buffer(), np.int16) for y in x])
        for shard in sorted(got):
            classes, sizes, leads = (np.concatenate(x) for x in zip(*got.pop(shard), strict=True))
            end = np.cumsum(sizes.astype(np.int64))
            start = end - sizes
            order = np.lexsort((leads, H.spans(_sums(classes.view(np.uint16)), start, end)))  # the order of arrival doesn't count
            n = sizes[order].astype(np.int64)
            classes = classes[np.repeat(start[order] - np.cumsum(n) + n, n) + np.arange(len(classes))]
            windows = M.windows_of(classes.astype(np.int32), np.cumsum(n), leads[order])
            w = M.train(weights.value, tables.value, windows, rate)
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(windows)], pa.int64()), pa.array([_flat(w).astype(np.float32).tobytes()], pa.binary())], names=["shard", "n", "weights"])

    return run


def _flat(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in sorted(w)])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = None, 0
    for batch in batches:
        for k, x in zip(batch.column("n").to_pylist(), batch.column("weights"), strict=True):
            mine = np.frombuffer(x.as_buffer(), np.float32).astype(float) * k
            total, n = mine if total is None else total + mine, n + k
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["n", "weights"])


BEGINS = 17  # bits of a hash that lead to its place among sorted ones


def begins_of(known: np.ndarray) -> np.ndarray:
    """Where the hashes (sorted) with each value of the first bits begin, and the end."""
    return np.searchsorted(known >> np.uint64(64 - BEGINS), np.arange((1 << BEGINS) + 1, dtype=np.uint64))


def found(known: np.ndarray, names: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Place of each name among known ones (sorted); any place if it isn't there."""
    first = (names >> np.uint64(64 - BEGINS)).astype(np.int64)
    at, end = begins[first], begins[first + 1]
    left = np.flatnonzero(at < end)
    left = left[known[at[left]] != names[left]]
    while len(left):
        at[left] += 1
        left = left[at[left] < end[left]]
        left = left[known[at[left]] != names[left]]
    return np.minimum(at, len(known) - 1)


class Scorer:
    """What scoring needs, one object for each broadcast: classes, emissions, weights, tables, the frequent words, and sums of counts."""

    def __init__(self, class_of, emission, weights, tables, opens, often, often_counts, sums, class_words, class_distinct):
        self.class_of, self.emission, self.weights, self.tables, self.opens = class_of, emission, weights, tables, opens
        self.often, self.often_counts = often, often_counts
        self.begins = begins_of(often)
        _, _, once, twice = sums
        self.discount = min(0.9, max(0.1, once / max(1, once + 2 * twice)))
        with np.errstate(divide="ignore"):
            self.log_words = np.log(class_words)
            self.log_left = np.where(class_words > 0, np.log(self.discount * class_distinct) - np.log(np.maximum(class_words, 1)), 0.0)

    def tokens(self, ids: np.ndarray, offsets: np.ndarray, rare: np.ndarray, rare_counts: np.ndarray):
        """For each word and end: its text, its log chance, and its count in all training text. rare: the texts' words that aren't
        frequent."""
        first, names, of = words(ids, offsets, self.opens)
        count = np.zeros(len(names), np.int64)
        order = np.argsort(rare)
        for known, counts in ((self.often, self.often_counts), (rare[order], rare_counts[order])):
            if len(known):
                at = found(known, names, self.begins) if known is self.often else np.minimum(np.searchsorted(known, names), len(known) - 1)
                count = np.where(known[at] == names, counts[at], count)
        return of, self.copied(self.chances(ids, offsets, first, count), names, of), count

    def chances(self, ids: np.ndarray, offsets: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Log chance of each token by attention and frequencies; first: where tokens begin."""
        x, target, opening = M.blocks(self.class_of[ids], offsets)
        chance, on = M.log_chances(self.weights, self.tables, x, target, opening)
        real = target.ravel() >= 0
        chance, on, emission = chance[real].astype(float), on[real].astype(float), self.emission[ids]
        steps = emission + np.where(self.opens[ids], 0, chance + on)
        spelt = np.add.reduceat(steps, first) if len(first) else np.zeros(0)
        kind = self.class_of[ids[first]]
        spelt = np.where(kind == M.END_CLASS, 0, spelt + np.append(on[first[1:]], 0))  # a word ends where the next token opens
        with np.errstate(divide="ignore"):
            seen = np.where(count > 0, np.log(np.maximum(count - self.discount, 1e-9)) - self.log_words[kind], -np.inf)
        return chance[first] + np.where(kind == M.END_CLASS, 0, np.logaddexp(seen, self.log_left[kind] + spelt))

    @staticmethod
    def copied(logs: np.ndarray, names: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Log chances with the share that words read before in the text have: by how often the token was among them."""
        key = H.mixed(names + of.astype(np.uint64) * H.BASE)
        order = np.argsort(key)
        key = key[order]
        first = np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]])
        same = (np.cumsum(first) << 32) | order  # tokens of a kind in the order of the text
        same.sort()
        new = np.flatnonzero(first)
        before = np.zeros(len(key), np.int64)
        before[same & 0xFFFFFFFF] = np.arange(len(key)) - np.repeat(new, np.diff(np.append(new, len(key))))
        read = np.arange(len(of)) - np.searchsorted(of, of)
        share = COPIED * read / (read + COPY_RISE)
        with np.errstate(divide="ignore"):
            return np.logaddexp(np.log1p(-share) + logs, np.log(share * before / np.maximum(read, 1)))


def _scored(scorer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scorer.value
        for batch in batches:
            ids, offsets = _joined(batch.column("ids"))
            rare, rare_counts = ([np.frombuffer(x or b"", kind) for x in batch.column(c).to_pylist()] for c, kind in (("names", np.uint64), ("counts", np.int64)))
            out = [np.zeros((0, 3))]
            for a, b in chunks(offsets, 1 << 18):
                of, logs, count = own.tokens(ids[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], np.concatenate(rare[a:b]), np.concatenate(rare_counts[a:b]))
                out.append(np.stack([np.bincount(of, v, b - a) for v in (np.log10(count + 1.0), count > 0, logs / LOG10)], 1))
            got = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "held_out", "n_tokens")], pa.array(got[:, 0]), pa.array(got[:, 1].astype(np.int64)), pa.array(got[:, 2])], names=["doc_id", "held_out", "n_tokens", "adds", "known", "score"])

    return run


def lm_scores(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_token.

    Texts are taken whole, A-Z in lower case; tokens are words and one end. Training takes rows whose crc32(doc_id) mod 7
    is not 2; rows with a null id are held out of nothing and train too. Null counts as an empty text, which has the end alone. base_score is
    the add-one unigram log10 chance, score the model's log10 chance of the text. Without training rows counts are
    0 and the model is nearly uniform. Rows that repeat are each counted and scored. Other columns are ignored. Nothing depends on
    the order of rows or how they are partitioned, but for the last digits of sums.
    """
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    parts = partitions(spark)
    with open(path, encoding="utf-8") as f:
        file = f.read()
    own = codec(file)
    opens = opening_ids(own.bytes)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), held_out(F.col(doc_id), 2, 7).alias("held_out"), F.monotonically_increasing_id().alias("row"))
    coded = stored(rows.mapInArrow(_tokenised(share(file)), "doc_id long, held_out boolean, row long, n_tokens long, ids binary, digest long"), "lm-ids", "zstd")
    training = coded.where("not held_out")

    # classes of subwords: the most frequent have their own, the rest share a few
    counts = np.zeros(65536, np.int64)
    got = training.mapInArrow(_id_counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts[got["id"]] = got["n"]
    order = np.lexsort((np.arange(65536), -counts))
    order = order[order < END]
    class_of, emission = np.full(65536, M.END_CLASS, np.int32), np.zeros(65536)
    single, rest = order[: M.CLASSES - 1 - M.SHARED], order[M.CLASSES - 1 - M.SHARED :]
    class_of[single] = np.arange(1, len(single) + 1)
    ascii_only = np.array([all(c < 128 for c in own.bytes.get(i, b"")) for i in rest.tolist()])
    class_of[rest] = M.CLASSES - M.SHARED + opens[rest] * 2 + ascii_only
    for c in range(M.CLASSES - M.SHARED, M.CLASSES):
        members = rest[class_of[rest] == c]
        emission[members] = np.log((counts[members] + 1) / (counts[members].sum() + len(members)))
    class_opens = np.zeros(M.CLASSES, bool)
    class_opens[class_of[opens & (np.arange(65536) <= END)]] = True
    class_of_b, opens_b = share(class_of), share(opens)

    # neighbouring classes, over all training text
    got = training.mapInArrow(_pairs(class_of_b), "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).toPandas()
    pairs = np.zeros((M.CLASSES, M.CLASSES))
    pairs[got["a"], got["b"]] = got["n"]
    tables = share(M.Tables(pairs, class_opens))

    # attention, by rounds of training in shards whose weights are averaged, in two steps
    shards = math.ceil(int(counts.sum()) / ROUNDS / SHARD_TOKENS)
    tasks, groups = min(shards, max(parts, shards // 16)), math.isqrt(max(0, shards - 1)) + 1
    weights = M.start_weights(tables.value)
    for i in range(ROUNDS if shards else 0):
        drawn = training.mapInArrow(_segments(class_of_b, i, shards), _SEGMENTS_SQL).repartitionById(tasks, F.col("shard") % tasks)
        trained = drawn.mapInArrow(_trained(share(weights), tables, RATE / (1 + i)), "shard int, n long, weights binary")
        got = trained.repartitionById(groups, F.col("shard") % groups).mapInArrow(_added, "n long, weights binary").toPandas()
        if not len(got):
            break
        mean = sum(np.frombuffer(x, float) for x in sorted(got["weights"])) / got["n"].sum()
        cuts = np.cumsum([weights[k].size for k in sorted(weights)])[:-1]
        weights = {k: x.reshape(weights[k].shape).astype(np.float32) for k, x in zip(sorted(weights), np.split(mean, cuts), strict=True)}

    # exact counts of words; the sample only tells whose counts to broadcast
    top = training.mapInArrow(_some_words(opens_b), "name long, n long").groupBy("name").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "name").limit(FREQUENT).toPandas()
    frequent = share(np.sort(top["name"].to_numpy(np.int64).view(np.uint64)))
    counted = coded.mapInArrow(_counted(parts, opens_b, frequent, class_of_b), _COUNTS_SQL).repartitionById(parts, F.col("part"))
    summed = stored(counted.mapInArrow(_summed(parts, frequent), _SUMMED_SQL), "lm-counts", "zstd")
    totals = summed.where("part = -1")
    listed = totals.select("often", "often_counts").toPandas()
    often = np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(x, np.uint64) for x in listed["often"]]])
    often_counts = np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(x, np.int64) for x in listed["often_counts"]]])
    sort = np.argsort(often)

    def added(column: str, size: int) -> np.ndarray:
        got = totals.select(F.posexplode(column).alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).toPandas()
        out = np.zeros(size, np.int64)
        out[got["i"]] = got["n"]
        return out

    sums = added("sums", 4)
    n, v = int(sums[0]), int(sums[1])
    scorer = share(Scorer(class_of, emission, weights, tables.value, opens, often[sort], often_counts[sort], sums.tolist(), added("class_words", M.CLASSES), added("class_distinct", M.CLASSES)))
    rare = summed.where("part >= 0").select("part", "docs", "names", "counts").repartitionById(parts, F.col("part")).mapInArrow(_by_row, "row long, names binary, counts binary")
    held = coded.join(rare, "row", "left").select("doc_id", "held_out", "n_tokens", "ids", "names", "counts")
    out = held.mapInArrow(_scored(scorer), "doc_id long, held_out boolean, n_tokens long, adds double, known long, score double")
    base = F.col("adds") - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))
    return out.select("doc_id", "held_out", "n_tokens", F.col("known").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score", (-F.col("score") / F.log10(F.lit(2.0)) / F.col("n_tokens")).alias("bits_per_token"))
