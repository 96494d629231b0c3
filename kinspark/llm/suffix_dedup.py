"""Removal of repeated passages by suffix arrays that are built in many small parts.

Two equal strings of LENGTH bytes have the same minimizer (the KGRAM bytes in them with the least hash) at the same place. So
texts are cut into segments, each the strings that share a minimizer, and segments are dealt by the minimizer's hash: all
equal strings meet in one part. Minimizers that no two documents share are left out first. Each part builds a suffix array by
two-stage sorting: only suffixes smaller than their successors are sorted, scans over the buckets of first bytes induce
the others; adjacent common prefixes then tell which strings are equal.

Hot passages: a task reports repeats that it sees itself, and sends on the bytes of only one of equal segments, of its smallest
document; that document's others go along as their starts alone and share what is found out about the one. Strings around a minimizer that very many documents share are dealt one by one, by all their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as H
from .util import as_bytes, binary_rows, by_key, chunks, partitions, small, stored

LENGTH, KGRAM = 50, 20
AROUND = LENGTH - KGRAM  # a minimizer lies up to so many bytes behind its string's start
FLUSH = 2_000_000  # minimizers that a task gathers before it sends them on
CUT_BYTES = 24 << 20  # bytes of segments likewise
PART_BYTES = 3 << 20  # text of one suffix array, about
BORDER = 0xFF  # never a byte of UTF-8 text; ends each segment
HOT_SHARE = 50  # a minimizer is hot if it makes up more than a part's mean load divided by this


def two_stage_suffix_array(t: np.ndarray, depth: int = 56) -> np.ndarray:
    """Suffix array of bytes t, right to depth bytes (suffixes with longer common prefixes are in any order)."""
    n = len(t)
    if n == 0:
        return np.zeros(0, np.int64)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(t[1:].astype(np.int16) - t[:-1])
    step[-1] = -1
    fixed = np.flatnonzero(step)
    step = step[fixed[np.searchsorted(fixed, np.arange(n))]]  # equal bytes go on as what follows them
    rising = step > 0  # smaller than its successor

    # stage one: sort the rising suffixes by eight bytes at a time, ties alone by the next eight
    words = eight_bytes(t, depth + 8)
    sa_b = np.flatnonzero(rising)
    sa_b = sa_b[np.argsort(words[sa_b], kind="stable")]
    key = words[sa_b]
    group = np.zeros(len(sa_b), np.int64)
    group[1:] = np.cumsum(key[1:] != key[:-1])
    for d in range(8, depth, 8):
        same = np.zeros(len(sa_b), bool)
        same[1:] = group[1:] == group[:-1]
        same[:-1] |= same[1:]
        tied = np.flatnonzero(same)
        if not len(tied):
            break
        at, g = sa_b[tied], group[tied]
        key = words[at + d]
        order = np.lexsort((key, g))
        sa_b[tied], key = at[order], key[order]
        new = np.zeros(len(tied), bool)
        new[1:] = (g[1:] == g[:-1]) & (key[1:] != key[:-1])
        bump = np.zeros(len(sa_b), np.int64)
        bump[tied] = new
        group += np.cumsum(bump)

    del words, key, group
    # stage two: a bucket holds falling suffixes, then rising ones; each found suffix gives the place of a larger one before it
    sa = np.empty(n, np.int64)
    sizes = np.bincount(t, minlength=256)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    rising_sizes = np.bincount(t[sa_b], minlength=256)
    rising_ends = np.cumsum(rising_sizes)
    fill = starts.copy()
    sa[fill[t[-1]]] = n - 1
    fill[t[-1]] += 1
    for c in np.flatnonzero(sizes):
        done = starts[c]
        while done < fill[c]:  # runs of one byte induce within their bucket
            now = sa[done : fill[c]]
            done = fill[c]
            before = now[now > 0] - 1
            before = before[t[before] == c]
            sa[done : done + len(before)] = before
            fill[c] += len(before)
        sa[fill[c] : ends[c]] = sa_b[rising_ends[c] - rising_sizes[c] : rising_ends[c]]
        all_ = sa[starts[c] : ends[c]]
        before = all_[all_ > 0] - 1
        first = t[before]
        up = first > c
        before, first = before[up], first[up]
        before = before[np.argsort(first, kind="stable")]
        at = 0
        for d, m in enumerate(np.bincount(first, minlength=256).tolist()):
            if m:
                sa[fill[d] : fill[d] + m] = before[at : at + m]
                fill[d] += m
                at += m
    return sa


def eight_bytes(t: np.ndarray, room: int) -> np.ndarray:
    """For each place, its next eight bytes as a number in their order; room places of BORDER follow the end."""
    x = np.concatenate([t, np.full(room + 8, BORDER, np.uint8)]).astype(np.uint64)
    for k in (1, 2, 4):
        x = (x[:-k] << np.uint64(8 * k)) | x[k:]
    return x


def common_prefixes(words: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int = 56) -> np.ndarray:
    """Length of the common prefix at each pair of places, up to depth."""
    if len(a) > 1 << 18:  # a part at a time: temporaries are many times as large
        return np.concatenate([common_prefixes(words, a[i : i + (1 << 18)], b[i : i + (1 << 18)], depth) for i in range(0, len(a), 1 << 18)])
    out = np.full(len(a), depth, np.int64)
    on = np.arange(len(a))
    for d in range(0, depth, 8):
        x = words[a[on] + d] ^ words[b[on] + d]
        differ = x != 0
        lead = np.zeros(differ.sum(), np.int64)
        for k in range(1, 8):
            lead += x[differ] < np.uint64(1) << np.uint64(64 - 8 * k)
        out[on[differ]] = d + lead
        on = on[~differ]
    return out


def _sliding(x: np.ndarray, n: int, best) -> np.ndarray:
    """best of each n places in a row."""
    have = 1
    while 2 * have <= n:
        x = best(x[:-have], x[have:])
        have *= 2
    rest = n - have
    return best(x[:-rest], x[rest:]) if rest else x


def minimizers(data: np.ndarray, offsets: np.ndarray):
    """Of texts that lie end to end: places of minimizers, their hashes and texts; then the least hash of each string's k-grams."""
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sums = H.running(data)
    gram = H.mixed((sums[KGRAM:] - sums[:-KGRAM]) * H.powers(n + 1)[1][: n - KGRAM + 1])
    least = _sliding(gram, AROUND + 1, np.minimum)  # by the string's start
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(least)]
    inside = np.arange(len(least)) + LENGTH <= offsets[text + 1]
    most = np.where(inside, least, np.uint64(0))  # strings across a border don't count
    padded = np.concatenate([np.zeros(AROUND, np.uint64), most, np.zeros(len(gram) - len(least), np.uint64)])
    chosen = np.flatnonzero(_sliding(padded, AROUND + 1, np.maximum)[: len(gram)] == gram)
    of = np.searchsorted(offsets, chosen, side="right") - 1
    # a k-gram of one text may equal the least hash of a string that ends in the text before: drop what has no string of its own
    return chosen, gram[chosen], of, most


def segments(chosen: np.ndarray, names: np.ndarray, most: np.ndarray, starts: np.ndarray):
    """First and last string of each minimizer: those within AROUND before it whose least hash is its own, in the same text."""
    places = chosen[:, None] - np.arange(AROUND, -1, -1)[None]
    ok = (places >= starts[:, None]) & (places < len(most))
    ok &= most[np.clip(places, 0, max(0, len(most) - 1))] == names[:, None]
    some = ok.any(1)
    first = ok.argmax(1)
    last = AROUND - ok[:, ::-1].argmax(1)
    return some, chosen - AROUND + first, chosen - AROUND + last


def _first_of(keys: np.ndarray, docs: np.ndarray):
    """Order by key, then document; where each key begins; its number of rows."""
    order = np.lexsort((docs, keys))
    k = keys[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    at = np.flatnonzero(new)
    return order, at, np.diff(np.append(at, len(k)))


def _by_doc(docs: np.ndarray, *values: np.ndarray):
    """Documents, and the packed values of each."""
    order = np.argsort(docs, kind="stable")
    d = docs[order]
    at = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]])) if len(d) else np.zeros(0, np.int64)
    ends = np.append(at[1:], len(d))
    return d[at], [binary_rows(v[order], ends if len(d) else np.zeros(0, np.int64)) for v in values]


_NAMES = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("names", pa.binary()), ("docs", pa.binary()), ("counts", pa.binary())])
_NAMES_SQL = "part int, doc_id long, names binary, docs binary, counts binary"


def _gather(parts: int):
    """Minimizers of each document, for the parts that find out which are shared."""

    def flush(held) -> Iterator[pa.RecordBatch]:
        names, docs = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order, at, count = _first_of(names, docs)
        names, docs = names[order], docs[order]
        many = np.repeat(count, count) > 1
        own, (packed,) = _by_doc(docs[many], names[many])
        yield pa.RecordBatch.from_arrays([pa.array((own % parts).astype(np.int32)), pa.array(own), packed, pa.nulls(len(own), pa.binary()), pa.nulls(len(own), pa.binary())], schema=_NAMES)
        names, docs, count = names[at], docs[at], np.minimum(count, 65535).astype(np.uint16)
        part = (names >> np.uint64(32)) % np.uint64(parts)
        order = np.lexsort((docs, part))
        part = part[order]
        which, begin = np.unique(part, return_index=True)
        ends = np.append(begin[1:], len(part))
        low = (names[order] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), pa.nulls(len(which), pa.int64()), binary_rows(low, ends), binary_rows(docs[order], ends), binary_rows(count[order], ends)], schema=_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            data, offsets = as_bytes(batch.column("text"))
            for a, b in chunks(offsets):
                _, names, of, _ = minimizers(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                docs = ids[a:b][of]
                pair = H.mixed(names ^ (docs.astype(np.uint64) * H.BASE))
                keep = np.unique(pair, return_index=True)[1]  # once for each document
                held.append((names[keep], docs[keep]))
                n += len(keep)
                if n > FLUSH:
                    yield from flush(held)
                    held, n = [], 0
        if n:
            yield from flush(held)

    return run


def _shared(parts: int):
    """Of a part's minimizers, those of two documents: documents with the low halves of their hashes. Rows without a document
    name the hot ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, docs, counts = [], [], []
        for batch in batches:
            local = np.asarray(batch.column("doc_id").is_valid())
            if local.any():
                rows = batch.filter(pa.array(local))
                low = [(np.frombuffer(x.as_buffer(), np.uint64) & np.uint64(0xFFFFFFFF)).astype(np.uint32) for x in rows.column("names")]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), binary_rows(np.concatenate(low), np.cumsum([len(x) for x in low]))], names=["doc_id", "names"])
            for row in np.flatnonzero(~local):
                key = np.frombuffer(batch.column("names")[row].as_buffer(), np.uint32).astype(np.uint64)
                names.append(key | np.uint64(batch.column("part")[row].as_py()) << np.uint64(32))
                docs.append(np.frombuffer(batch.column("docs")[row].as_buffer(), np.int64))
                counts.append(np.frombuffer(batch.column("counts")[row].as_buffer(), np.uint16))
        if not names:
            return
        names, docs, counts = np.concatenate(names), np.concatenate(docs), np.concatenate(counts)
        order, at, count = _first_of(names, docs)
        names, docs, counts = names[order], docs[order], counts[order].astype(np.int64)
        total = np.add.reduceat(counts, at)
        hot = names[at][total > max(64, len(names) // HOT_SHARE)]
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), binary_rows((hot & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.array([len(hot)]))], names=["doc_id", "names"])
        many = np.repeat(count, count) > 1
        own, (packed,) = _by_doc(docs[many], (names[many] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        yield pa.RecordBatch.from_arrays([pa.array(own), packed], names=["doc_id", "names"])

    return run


_SEGS = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("starts", pa.binary()), ("ends", pa.binary()), ("docs", pa.binary()), ("names", pa.binary()), ("bytes", pa.binary()), ("again_of", pa.binary()), ("again", pa.binary())])
_SEGS_SQL = "part int, doc_id long, starts binary, ends binary, docs binary, names binary, bytes binary, again_of binary, again binary"


def _gathered_bytes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Spans of data end to end; places are made out for a megabyte at a time, being eight times as large as the bytes."""
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if len(ends) else 0, data.dtype)
    i = 0
    while i < len(size):
        done = int(ends[i] - size[i])
        j = max(i + 1, int(np.searchsorted(ends, done + (1 << 20), side="right")))
        n = size[i:j]
        out[done : int(ends[j - 1])] = data[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[i:j], n)]
        i = j
    return out


def _cut(parts: int, hot):
    """Segments around shared minimizers, for the parts that sort suffixes; repeats within a task are reported at once."""

    def flush(held) -> Iterator[pa.RecordBatch]:
        keys, route, docs, first, last, text = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        size = last - first + LENGTH
        place = np.cumsum(size) - size
        order, at, count = _first_of(keys, docs)
        lead = np.repeat(order[at], count)
        repeat = order[docs[order] > docs[lead]]
        own, packed = _by_doc(docs[repeat], first[repeat].astype(np.uint32), (last[repeat] + LENGTH).astype(np.uint32))
        none = pa.nulls(len(own), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array((own % parts).astype(np.int32)), pa.array(own), *packed, none, none, none, none, none], schema=_SEGS)
        again = np.flatnonzero((docs[order] == docs[lead]) & (order != lead))  # places in order, so by group
        per_group = np.bincount(np.repeat(np.arange(len(at)), count)[again], minlength=len(at))
        again_begin = np.cumsum(per_group) - per_group
        again = first[order[again]].astype(np.uint32)
        sent = order[at]
        part = route[sent] % np.uint64(parts)
        by_part = np.argsort(part, kind="stable")
        sent, part, per_group, again_begin = sent[by_part], part[by_part], per_group[by_part], again_begin[by_part]
        for i in range(0, len(sent), 1 << 17):
            s, p = sent[i : i + (1 << 17)], part[i : i + (1 << 17)]
            which, begin = np.unique(p, return_index=True)
            ends = np.append(begin[1:], len(p))
            raw = _gathered_bytes(text, place[s], size[s])
            n_again = per_group[i : i + (1 << 17)]
            again_of = np.repeat(np.arange(len(s)) - np.repeat(begin, ends - begin), n_again).astype(np.uint32)
            again_ends = np.cumsum(n_again)[ends - 1]
            yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), pa.nulls(len(which), pa.int64()), binary_rows(first[s].astype(np.uint32), ends), binary_rows((last[s] + LENGTH).astype(np.uint32), ends),
                                              binary_rows(docs[s], ends), binary_rows(route[s], ends), binary_rows(raw, np.cumsum(size[s])[ends - 1]),
                                              binary_rows(again_of, again_ends), binary_rows(_gathered_bytes(again, again_begin[i : i + (1 << 17)], n_again), again_ends)], schema=_SEGS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        hot_names = hot.value
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            data, offsets = as_bytes(batch.column("text"))
            flags = [np.concatenate([np.frombuffer(x, np.uint32) for x in row]) for row in batch.column("names").to_pylist()]
            for a, b in chunks(offsets):
                part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                chosen, names, of, most = minimizers(part, own)
                flagged = np.concatenate(flags[a:b]).astype(np.uint64) | np.repeat(np.arange(b - a), [len(f) for f in flags[a:b]]).astype(np.uint64) << np.uint64(32)
                keep = np.isin((names & np.uint64(0xFFFFFFFF)) | of.astype(np.uint64) << np.uint64(32), flagged)
                chosen, names, of = chosen[keep], names[keep], of[keep]
                some, first, last = segments(chosen, names, most, own[of])
                names, of, first, last = names[some], of[some], first[some], last[some]
                wide = np.isin((names & np.uint64(0xFFFFFFFF)).astype(np.uint32), hot_names)
                if wide.any():  # one segment for each string around a hot minimizer
                    size = (last - first + 1)[wide]
                    each = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[wide], size)
                    each_of = np.repeat(of[wide], size)
                    same = most[each] == np.repeat(names[wide], size)
                    each, each_of = each[same], each_of[same]
                    first, last, of = np.concatenate([first[~wide], each]), np.concatenate([last[~wide], each]), np.concatenate([of[~wide], each_of])
                sums = H.running(part)
                key = H.spans(sums, first, last + LENGTH)
                route = np.concatenate([H.mixed(names[~wide]), key[len(names[~wide]) :]]) if wide.any() else H.mixed(names)
                raw = _gathered_bytes(part, first, last - first + LENGTH)
                held.append((key, route, ids[a:b][of], first - own[of], last - own[of], raw))
                n += len(raw)
                if n > CUT_BYTES:
                    yield from flush(held)
                    held, n = [], 0
        if n:
            yield from flush(held)

    return run


def repeats(text: np.ndarray, size: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each place of segments that lie end to end (sizes, documents): whether the string of LENGTH bytes there also starts in a
    segment of a smaller document."""
    ends = np.cumsum(size)
    joined = np.insert(text, ends, BORDER)
    begin = ends - size + np.arange(len(size))
    segment = np.repeat(np.arange(len(size)), size + 1)
    whole = np.arange(len(joined)) <= (begin + size - LENGTH)[segment]
    del segment
    sa = two_stage_suffix_array(joined)
    sa = sa[whole[sa]]
    out = np.zeros(len(joined), bool)
    if len(sa):
        lcp = common_prefixes(eight_bytes(joined, 72), sa[:-1], sa[1:])
        group = np.concatenate([[0], np.flatnonzero(lcp < LENGTH) + 1])
        doc = docs[np.searchsorted(ends + np.arange(len(size)), sa)]
        least = np.minimum.reduceat(doc, group)
        out[sa] = doc > np.repeat(least, np.diff(np.append(group, len(sa))))
    return np.delete(out, ends + np.arange(len(size)))


def _sorted(parts: int):
    """Ranges to remove: those that tasks reported, and those that a part's suffix arrays show; one row for each part that the
    ranges' documents go to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.uint32)), *_ranges(batches)]
        docs, starts, ends = (np.concatenate(x) for x in zip(*found, strict=True))
        part = docs % parts
        order = np.lexsort((starts, docs, part))
        which, begin = np.unique(part[order], return_index=True)
        if len(which):
            upto = np.append(begin[1:], len(order))
            yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), *[binary_rows(x[order], upto) for x in (docs, starts, ends)]], names=["part", "docs", "starts", "ends"])

    return run


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each document of a part, with all its ranges."""
    kinds = {"docs": np.int64, "starts": np.uint32, "ends": np.uint32}
    got = {k: [np.zeros(0, kind)] for k, kind in kinds.items()}
    for batch in batches:
        for k, kind in kinds.items():
            got[k] += [np.frombuffer(x.as_buffer(), kind) for x in batch.column(k)]
    docs, starts, ends = (np.concatenate(x) for x in got.values())
    own, packed = _by_doc(docs, starts, ends)
    yield pa.RecordBatch.from_arrays([pa.array(own), *packed], names=["doc_id", "starts", "ends"])


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Documents, starts and ends of ranges."""
    kinds = {"starts": np.uint32, "ends": np.uint32, "docs": np.int64, "names": np.uint64, "bytes": np.uint8, "again_of": np.uint32, "again": np.uint32}
    cols = {k: [] for k in kinds}
    for batch in batches:
        local = np.asarray(batch.column("doc_id").is_valid())
        if local.any():
            rows = batch.filter(pa.array(local))
            a, b = ([np.frombuffer(x.as_buffer(), np.uint32) for x in rows.column(c)] for c in ("starts", "ends"))
            yield np.repeat(rows.column("doc_id").to_numpy(), [len(x) for x in a]), np.concatenate(a), np.concatenate(b)
        for row in np.flatnonzero(~local):
            for k, v in cols.items():
                v.append(np.frombuffer(batch.column(k)[int(row)].as_buffer(), kinds[k]))
    if not cols["docs"]:
        return
    before = np.cumsum([0, *map(len, cols["docs"])])
    cols["again_of"] = [x + n for x, n in zip(cols["again_of"], before, strict=False)]  # a row's segments, among all
    starts, ends, docs, names, text, again_of, again = (np.concatenate(v) for v in cols.values())
    starts, ends = starts.astype(np.int64), ends.astype(np.int64)
    size = ends - starts
    place = np.cumsum(size) - size
    pieces = max(1, int(size.sum()) // PART_BYTES)
    piece = (names >> np.uint64(20)) % np.uint64(pieces)
    by_piece = np.argsort(piece, kind="stable")
    borders = np.searchsorted(piece[by_piece], np.arange(pieces + 1))
    again_by_piece = np.argsort(piece[again_of], kind="stable")
    again_borders = np.searchsorted(piece[again_of][again_by_piece], np.arange(pieces + 1))
    where = np.empty(len(piece), np.int64)
    where[by_piece] = np.arange(len(piece)) - borders[:-1][piece[by_piece].astype(np.int64)]
    for i in range(pieces):
        mine = by_piece[borders[i] : borders[i + 1]]
        if not len(mine):
            continue
        raw = _gathered_bytes(text, place[mine], size[mine])
        at = np.cumsum(size[mine]) - size[mine]
        key = H.spans(H.running(raw), at, at + size[mine])
        order, head, count = _first_of(key, docs[mine])  # equal segments: all but the smallest document's are repeats
        lead = np.repeat(order[head], count)
        copy = order[docs[mine][order] > docs[mine][lead]]
        only = order[head]
        group = np.empty(len(mine), np.int64)
        group[order] = np.repeat(np.arange(len(head)), count)
        more = again_by_piece[again_borders[i] : again_borders[i + 1]]
        more_of, more_at = where[again_of[more]], again[more].astype(np.int64)
        gone = docs[mine][more_of] > docs[mine][only][group[more_of]]  # of a copy
        gone_of, gone_at = more_of[gone], more_at[gone]
        twin = order[(docs[mine][order] == docs[mine][lead]) & (order != lead)]
        # all places of each of only: its own, and the same document's others
        holder = np.concatenate([np.arange(len(only)), group[more_of[~gone]], group[twin]])
        holder_at = np.concatenate([starts[mine][only], more_at[~gone], starts[mine][twin]])[np.argsort(holder, kind="stable")]
        times = np.bincount(holder, minlength=len(only))
        hit = repeats(_gathered_bytes(raw, at[only], size[mine][only]), size[mine][only], docs[mine][only])
        run = np.flatnonzero(hit)
        cut = np.cumsum(size[mine][only])
        owner = np.searchsorted(cut, run, side="right")
        first = np.ones(len(run), bool)
        first[1:] = (run[1:] != run[:-1] + 1) | (owner[1:] != owner[:-1])
        head_at = np.flatnonzero(first)
        tail_at = np.append(head_at[1:], len(run)) - 1
        inside = run - (cut - size[mine][only])[owner] if len(run) else run
        which = owner[head_at]
        n = times[which]
        base = _gathered_bytes(holder_at, (np.cumsum(times) - times)[which], n)
        a = np.concatenate([starts[mine][copy], gone_at, base + np.repeat(inside[head_at], n)]).astype(np.uint32)
        b = np.concatenate([ends[mine][copy], gone_at + size[mine][gone_of], base + np.repeat(inside[tail_at], n) + LENGTH]).astype(np.uint32)
        d = np.concatenate([docs[mine][copy], docs[mine][gone_of], np.repeat(docs[mine][only][which], n)])
        yield d, a, b


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = as_bytes(batch.column("text"))
        out = {"starts": [], "ends": [], "sha": [], "removed": []}
        for i, (raw_a, raw_b) in enumerate(zip(batch.column("starts").to_pylist(), batch.column("ends").to_pylist(), strict=True)):
            a, b = np.frombuffer(raw_a, np.uint32).astype(np.int64), np.frombuffer(raw_b, np.uint32).astype(np.int64)
            order = np.argsort(a, kind="stable")
            a, b = a[order], np.maximum.accumulate(b[order])
            new = np.concatenate([[True], a[1:] > b[:-1]])
            a, b = a[new], b[np.append(np.flatnonzero(new)[1:] - 1, len(b) - 1)]
            text = data[offsets[i] : offsets[i + 1]]
            mask = np.ones(len(text), bool)
            for s, e in zip(a.tolist(), b.tolist(), strict=True):
                mask[s:e] = False
            out["starts"].append(a)
            out["ends"].append(b)
            out["removed"].append(int((b - a).sum()))
            out["sha"].append(hashlib.sha256(text[mask].tobytes()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out["removed"], pa.int64()), pa.array(out["sha"], pa.string()), pa.array(out["starts"], pa.list_(pa.int64())), pa.array(out["ends"], pa.list_(pa.int64()))],
                                         names=["doc_id", "n_removed", "kept_sha256", "span_starts", "span_ends"])


def repeated_passages(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, span_starts, span_ends (bytes; each removed run).

    A byte is removed if a string of LENGTH bytes over it also starts in a document with a smaller id, judged on the input.
    Null counts as an empty text. Rows that repeat an id are no reason to remove each other's text; if their texts differ, the one
    with the smallest SHA-256 takes part and the others stay whole, as do rows with a null id. Other columns are ignored.
    """
    spark = docs.sparkSession
    parts = partitions(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("sha", F.sha2("text", 256))
    base = stored(rows.select("doc_id", "sha", F.octet_length("text").cast("long").alias("n_bytes")), "suffix-base")
    copies = base.where("doc_id is not null").groupBy("sha").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    marked = by_key(base, stored(copies, "suffix-first"), "sha", n="n").select("doc_id", "sha", "n_bytes", F.coalesce("first_id", "doc_id").alias("first_id"))
    marked = stored(marked, "suffix-copies")
    part_ids = marked.where("doc_id = first_id and n_bytes >= 50").groupBy("doc_id").agg(F.min("sha").alias("own_sha"))
    idle = stored(marked.join(part_ids, "doc_id", "left").where("own_sha is null or sha <> own_sha").select("doc_id", "sha").distinct(), "suffix-idle")
    taking = rows.where("doc_id is not null").join(small(idle), ["doc_id", "sha"], "left_anti").select("doc_id", "text")
    taking = taking.where(F.octet_length("text") >= LENGTH)

    gathered = taking.mapInArrow(_gather(parts), _NAMES_SQL).repartitionById(parts, F.col("part"))
    shared = stored(gathered.mapInArrow(_shared(parts), "doc_id long, names binary"), "suffix-shared")
    hot = [np.frombuffer(r[0], np.uint32) for r in shared.where("doc_id is null and octet_length(names) > 0").select("names").collect()]
    hot = spark.sparkContext.broadcast(np.unique(np.concatenate([np.zeros(0, np.uint32), *hot])))
    flags = shared.where("doc_id is not null").groupBy("doc_id").agg(F.collect_list("names").alias("names"))
    ids = small(stored(shared.where("doc_id is not null").select("doc_id").distinct(), "suffix-flagged"))
    found = taking.join(ids, "doc_id", "left_semi").join(flags, "doc_id").select("doc_id", "text", "names")
    cut = found.mapInArrow(_cut(parts, hot), _SEGS_SQL).repartitionById(parts, F.col("part"))
    packed = cut.mapInArrow(_sorted(parts), "part int, docs binary, starts binary, ends binary").repartitionById(parts, F.col("part"))
    ranges = stored(packed.mapInArrow(_by_document, "doc_id long, starts binary, ends binary"), "suffix-ranges")

    ids = small(stored(ranges.select("doc_id").distinct(), "suffix-hit"))
    removed = taking.join(ids, "doc_id", "left_semi").join(ranges, "doc_id").select("doc_id", "text", "starts", "ends")
    removed = stored(removed.dropDuplicates(["doc_id"]).mapInArrow(_kept, "doc_id long, n_removed long, kept_sha256 string, span_starts array<long>, span_ends array<long>"), "suffix-removed")
    x = marked.join(part_ids, "doc_id", "left").join(removed, "doc_id", "left")
    copy = F.coalesce((F.col("doc_id") > F.col("first_id")) & (F.col("n_bytes") >= LENGTH), F.lit(False))
    own = F.coalesce(F.col("sha") == F.col("own_sha"), F.lit(False)) & F.col("n_removed").isNotNull()
    zero, none = F.array().cast("array<long>"), F.lit(0).cast("long")
    pick = lambda whole, part, else_: F.when(copy, whole).when(own, part).otherwise(else_)
    return x.select(
        "doc_id", "n_bytes", pick(F.col("n_bytes"), F.col("n_removed"), none).alias("n_removed"), pick(F.lit(1).cast("long"), F.size("span_starts").cast("long"), none).alias("n_spans"),
        pick(F.lit(hashlib.sha256(b"").hexdigest()), F.col("kept_sha256"), F.col("sha")).alias("kept_sha256"),
        pick(F.array(F.lit(0).cast("long")), F.col("span_starts"), zero).alias("span_starts"), pick(F.array("n_bytes"), F.col("span_ends"), zero).alias("span_ends"))
