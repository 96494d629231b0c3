"""The numpy part of language-model scores: classes of subwords, causal attention over them, and its training.

A text is a row of subwords that ends with END. A subword either opens a word or goes on with one; END counts as one that opens.
Behind each subword the model first tells whether its word goes on, then which group of classes comes next among those that open a
word or among those that don't, then which class of that group, then which subword of that class. So the chances of all texts
add up to one. The logits of going on and of groups are log frequencies behind the last subword, over all training text, plus
what attention over the context adds; classes in a group go by their frequencies behind the last subword.
"""

from __future__ import annotations

import math

import numpy as np

BLOCK, WIDTH, CLASSES, SHARED = 8, 16, 1024, 4
FIRST_GROUPS, REST_GROUPS = 96, 48  # groups of classes that open a word, and of those that go on with one, at most
SMOOTH = 100  # pairs that all classes together are taken to have been seen in, besides those counted
END_CLASS = 0
PREPARED = 32  # steps of training that are prepared together
APART = 12  # places of a class that are added up as slices over all classes
_SEES = np.arange(2 * BLOCK)[None] <= np.arange(BLOCK)[:, None] + BLOCK
_MASK = np.where(_SEES, 0.0, -1e9).astype(np.float32)
_ONES = np.ones((2 * BLOCK, 2 * BLOCK), np.float32)
_DISTANCE = np.clip(np.arange(BLOCK)[:, None] + BLOCK - np.arange(2 * BLOCK)[None], 0, 2 * BLOCK - 1)
_AWAY = (_DISTANCE.ravel()[:, None] == np.arange(2 * BLOCK)).astype(np.float32)


def blocks(classes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs (the subword before, the end at a text's beginning) and targets in blocks of BLOCK, texts padded with -1; and which
    blocks begin a text."""
    n = np.diff(offsets)
    size = -(-n // BLOCK) * BLOCK
    begin = np.cumsum(size) - size
    place = np.arange(len(classes)) - np.repeat(offsets[:-1] - begin, n)
    target = np.full(int(size.sum()), -1, np.int32)
    target[place] = classes
    source = np.zeros(len(target), np.int32)
    source[1:] = np.maximum(target[:-1], 0)
    source[begin[n > 0]] = END_CLASS
    opening = np.zeros(len(target) // BLOCK, bool)
    opening[begin[n > 0] // BLOCK] = True
    return source.reshape(-1, BLOCK), target.reshape(-1, BLOCK), opening


def befores(x: np.ndarray, opening: np.ndarray) -> np.ndarray:
    """Inputs of the block before each block; END where a text begins, whose block before isn't seen."""
    before = np.concatenate([x[:1], x[:-1]])
    before[opening] = END_CLASS
    return before


class Tables:
    """Log frequencies of classes behind classes, from counts of pairs; opens tells which classes open a word. Classes that keep
    like company form groups: first and rest hold what groups have behind each class, inside what a class has in its group."""

    def __init__(self, pairs: np.ndarray, opens: np.ndarray):
        self.opens = opens
        goes_on = ~opens
        self.group, self.inside = np.zeros(len(opens), np.int64), np.zeros(pairs.shape, np.float32)
        self.first, self.rest = (self._logs(pairs, kind, n) for kind, n in ((opens, FIRST_GROUPS), (goes_on, REST_GROUPS)))
        on, all_ = pairs[:, goes_on].sum(1), pairs.sum(1)
        mean = (on.sum() + 1) / (all_[1:].sum() + 2)
        chance = (on + 2 * mean) / (all_ + 2)
        self.on = (np.log(chance) - np.log1p(-chance)).astype(np.float32)  # log odds that the word goes on

    def _logs(self, pairs: np.ndarray, kind: np.ndarray, n: int) -> np.ndarray:
        own = pairs[:, kind]
        alone = (own.sum(0) + 1) / (own.sum() + own.shape[1])
        chance = (own + SMOOTH * alone) / (own.sum(1, keepdims=True) + SMOOTH)
        behind = pairs[kind] + 20 * (pairs.sum(0) + 1) / (pairs.sum() + len(kind))
        group = groups(np.concatenate([np.sqrt(own.T / np.maximum(1, own.sum(0))[:, None]), np.sqrt(behind / behind.sum(1, keepdims=True))], 1), alone, n)
        by = np.stack([chance[:, group == g].sum(1) + 1e-30 for g in range(group.max() + 1)], 1)
        self.group[kind] = group
        self.inside[:, kind] = np.log(chance / by[:, group])
        return np.log(by).astype(np.float32)


def groups(x: np.ndarray, weight: np.ndarray, n: int, rounds: int = 15) -> np.ndarray:
    """Group of each row by k-means; the n heaviest rows are the first centres."""
    centres = x[np.argsort(-weight, kind="stable")[:n]].copy()
    for _ in range(rounds):
        near = ((centres**2).sum(1)[None] - 2 * x @ centres.T).argmin(1)
        for g in np.unique(near):
            centres[g] = np.average(x[near == g], 0, weight[near == g])
    return np.unique(near, return_inverse=True)[1]


def start_weights(tables: Tables, seed: int = 5) -> dict[str, np.ndarray]:
    """Attention starts at random and adds nothing yet."""
    rng = np.random.default_rng(seed)
    w = {k: rng.normal(0, 0.1, (CLASSES, WIDTH)) for k in "qkv"}
    w |= {"r": np.zeros(2 * BLOCK), "first": np.zeros((tables.first.shape[1], WIDTH)), "rest": np.zeros((tables.rest.shape[1], WIDTH)), "on": np.zeros(WIDTH)}
    return {k: v.astype(np.float32) for k, v in w.items()}


def attend(table: np.ndarray, distances: np.ndarray, seen: np.ndarray, opening: np.ndarray, turned: np.ndarray):
    """Queries, keys, values, attention, and the context of each place (rows of WIDTH) for inputs seen in blocks and those before them.
    table: rows of queries, keys and values; opening: the blocks that see none before; turned: room for keys."""
    n, kind = len(turned), table.dtype.type
    rows = table.take(seen.ravel(), 0).reshape(n, 2 * BLOCK, 3 * WIDTH)
    q, k, v = rows[:, BLOCK:, :WIDTH], rows[:, :, WIDTH : 2 * WIDTH], rows[:, :, 2 * WIDTH :]
    np.multiply(k.transpose(0, 2, 1), kind(WIDTH**-0.5), out=turned)
    s = q @ turned
    s += distances.take(_DISTANCE) + _MASK.astype(kind, copy=False)
    if len(opening):
        s[opening, :, :BLOCK] = -1e9
    if s.max() > 60:
        np.minimum(s, 60, out=s)
    np.exp(s, out=s)
    s /= (s.reshape(-1, 2 * BLOCK) @ _ONES.astype(kind, copy=False)).reshape(s.shape)  # sums, side by side as often as needed
    return q, k, v, s, (s @ v).reshape(-1, WIDTH)


def log_chances(w, tables: Tables, x: np.ndarray, target: np.ndarray, opening: np.ndarray, step: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """For each place the natural log chance of its target's class, given that the word ends or goes on before it as it does; and the
    log chance that it does (0 at a text's beginning). Padding gets 0 in both."""
    chance, odds = np.zeros(target.size, np.float32), np.zeros(target.size, np.float32)
    seen, last, t = np.concatenate([befores(x, opening), x], 1), x.ravel(), target.ravel()
    ends = tables.opens[np.maximum(t, 0)]
    inside = tables.inside.ravel().take(last * tables.inside.shape[1] + np.maximum(t, 0))
    group = tables.group[np.maximum(t, 0)]
    table, turned = np.concatenate([w[k] for k in "qkv"], 1), np.empty((step, WIDTH, 2 * BLOCK), np.float32)
    flat = {k: np.ascontiguousarray(w[k].T) for k in ("first", "rest")}
    for a in range(0, len(x), step):
        n, places = len(x[a : a + step]), slice(a * BLOCK, (a + step) * BLOCK)
        context = attend(table, w["r"], seen[a : a + n], np.flatnonzero(opening[a : a + n]), turned[:n])[-1]
        odds[places] = context @ w["on"]
        real, own_ends = t[places] >= 0, ends[places]
        for name, logs, kind in (("first", tables.first, real & own_ends), ("rest", tables.rest, real & ~own_ends)):
            at = np.flatnonzero(kind)
            own = context.take(at, 0)
            at += a * BLOCK
            logits = logs.take(last.take(at), 0)
            logits += own @ flat[name]
            hit = logits.ravel().take(np.arange(0, logits.size, logits.shape[1]) + group.take(at))
            np.exp(logits, out=logits)
            chance[at] = hit - np.log(logits @ np.ones(logits.shape[1], np.float32))
    odds += tables.on.take(last)
    np.negative(odds, out=odds, where=~ends)
    np.exp(odds, out=odds)
    np.log1p(odds, out=odds)
    chance += inside
    chance[t < 0] = odds[(t < 0) | (last == END_CLASS)] = 0
    return chance, np.negative(odds, out=odds)


def _packed(w) -> np.ndarray:
    """Weights as one array: a row of queries, keys and values for each class, then the others."""
    return np.concatenate([np.concatenate([w[k] for k in "qkv"], 1).ravel(), *[w[k].ravel() for k in ("first", "rest", "on", "r")]])


def _views(flat: np.ndarray, tables: Tables) -> tuple[np.ndarray, ...]:
    """Rows of queries, keys and values, then first, rest, on and r, as views of packed weights."""
    shapes = (CLASSES, 3 * WIDTH), (tables.first.shape[1], WIDTH), (tables.rest.shape[1], WIDTH), (WIDTH,), (2 * BLOCK,)
    parts = np.split(flat, np.cumsum([math.prod(x) for x in shapes])[:-1])
    return tuple(x.reshape(shape) for x, shape in zip(parts, shapes, strict=True))


class Steps:
    """Gradients for steps of equally many windows. What doesn't depend on the weights is worked out for all steps together: places by
    kind of target, tables behind them, and places by class of input."""

    def __init__(self, tables: Tables, x: np.ndarray, before: np.ndarray, target: np.ndarray, opening: np.ndarray, batch: int, kind=np.float32):
        n, self.tables = len(x) // batch, tables
        self.seen = np.concatenate([before, x], 1).reshape(n, -1)
        self.opening = [np.flatnonzero(o) for o in opening.reshape(n, batch)]
        last, t = x.reshape(n, -1), target.reshape(n, -1)
        kinds = np.where(t < 0, 2, np.where(tables.opens[np.maximum(t, 0)], 0, 1)).astype(np.int16)
        self.order = np.argsort(kinds, axis=1, kind="stable")  # places whose target opens a word, then those where one goes on, then padding
        self.back = np.empty_like(self.order)
        self.first, self.real = (kinds == 0).sum(1), (kinds < 2).sum(1)
        place = self.order + np.arange(n)[:, None] * t.shape[1]
        self.back.ravel()[place] = np.arange(t.shape[1])
        self.last, self.target = last.ravel().take(place), t.ravel().take(place)
        place, wide = np.arange(t.shape[1]), np.array([tables.first.shape[1], tables.rest.shape[1]])
        opens = place < self.first[:, None]
        self.hit = np.where(opens, place * wide[0], (place - self.first[:, None]) * wide[1]) + tables.group[self.target]
        self.on, self.sign = tables.on[self.last].astype(kind), np.where(opens, 1, -1).astype(kind)
        self.inside = (self.last != END_CLASS) & (self.target >= 0)
        self.weight = (self.sign * self.inside / np.maximum(1, self.real)[:, None]).astype(kind)
        # places of inputs: first one of each class, the most frequent classes first, then their second ones, and so on up to APART; then
        # the others by class. So sums by class are sums of slices, for all but the frequent classes' late places.
        size = self.seen.shape[1]
        bits = size.bit_length()
        key = np.sort((self.seen << bits) + np.arange(size), axis=1)
        changes = np.ones(key.shape, bool)
        changes[:, 1:] = key[:, 1:] >> bits != key[:, :-1] >> bits
        begin = np.flatnonzero(changes)
        held, step = np.diff(begin, append=key.size), begin // size
        rank = np.minimum(np.arange(key.size) - np.repeat(begin, held), APART)
        key += (rank * (size + 1) + size - np.repeat(held, held)).reshape(key.shape) * (CLASSES << bits)
        key.sort(axis=1)
        self.places = key & ((1 << bits) - 1)
        much = np.bincount(step * (APART + 1) + np.minimum(held, APART + 1) - 1, minlength=n * (APART + 1)).reshape(n, -1)
        self.held = much[:, ::-1].cumsum(1)[:, ::-1]  # classes with more than 0, 1, ... APART places
        late = np.flatnonzero(held > APART)
        late = late[np.lexsort((-held[late], step[late]))]
        late, many = held[late] - APART, self.held[:, APART]
        before = np.concatenate([[0], np.cumsum(late)])
        ends = np.cumsum(many)
        self.late = np.split(before[:-1] - np.repeat(before[ends - many], many), ends[:-1])
        self.grads = np.zeros((batch, 2 * BLOCK, 3 * WIDTH), kind)
        self.turned, self.outer = np.empty((batch, WIDTH, 2 * BLOCK), kind), (np.zeros((batch * BLOCK, WIDTH), kind), np.zeros((WIDTH, WIDTH), kind))
        self.ones, self.pair = np.ones((max(*wide, WIDTH, batch), max(WIDTH, 2 * BLOCK)), kind), np.result_type(kind, np.complex64)
        self.logs = [x.astype(kind, copy=False) for x in (tables.first, tables.rest)]

    def run(self, i: int, weights, tail: np.ndarray, want_loss: bool = False) -> tuple[np.ndarray, np.ndarray, float]:
        """Step i: the classes it meets and the gradient of their rows of queries, keys and values; its loss if wanted. The gradient of the
        other weights goes to tail."""
        table, w_first, w_rest, w_on, w_r = weights
        tables, kind, ones, loss = self.tables, self.grads.dtype.type, self.ones, 0.0
        batch, scale = len(self.grads), kind(WIDTH**-0.5)
        q, k, v, att, context = attend(table, w_r, self.seen[i], self.opening[i], self.turned)
        by_kind, last, n, m = context.take(self.order[i], 0), self.last[i], int(self.first[i]), int(self.real[i])
        odds = by_kind @ w_on
        odds += self.on[i]
        odds *= self.sign[i]
        if want_loss:
            loss += float(np.logaddexp(0, odds)[self.inside[i]].sum())
        np.negative(odds, out=odds)
        np.exp(odds, out=odds)
        odds += 1
        d_on = self.weight[i] / odds
        self.outer[0][:, 0], self.outer[1][0] = d_on, w_on
        d = self.outer[0] @ self.outer[1]  # faster than one row times one column
        at = 0
        for logs, w, a, b in ((self.logs[0], w_first, 0, n), (self.logs[1], w_rest, n, m)):
            own, g = by_kind[a:b], tail[at : at + w.size].reshape(w.shape)
            p = logs.take(last[a:b], 0)
            p += own @ w.T
            hit = self.hit[i, a:b]
            if want_loss:
                loss -= float(p.ravel()[hit].sum() + tables.inside[last[a:b], self.target[i, a:b]].sum())
            np.exp(p, out=p)
            sums = p @ ones[: len(w), :WIDTH]  # in all WIDTH columns
            if want_loss:
                loss += float(np.log(sums[:, 0]).sum())
            p.ravel()[hit] -= sums[:, 0]
            sums *= kind(max(1, m))
            np.matmul(p.T, own / sums, out=g)
            part = p @ w
            part /= sums
            d[a:b] += part
            at += w.size
        np.matmul(d_on, by_kind, out=tail[at : at + WIDTH])

        d = d.take(self.back[i], 0)
        context *= d
        dots = context @ ones[:WIDTH, : 2 * BLOCK]
        d = d.reshape(batch, BLOCK, WIDTH)
        np.copyto(self.turned, v.transpose(0, 2, 1))
        d_s = d @ self.turned
        d_s -= dots.reshape(d_s.shape)
        d_s *= att
        np.matmul(d_s.reshape(batch, -1).sum(0), _AWAY.astype(kind, copy=False), out=tail[at + WIDTH :])
        d_s *= scale
        grads = self.grads
        np.matmul(d_s, k, out=grads[:, BLOCK:, :WIDTH])
        np.matmul(d_s.transpose(0, 2, 1), q, out=grads[:, :, WIDTH : 2 * WIDTH])
        np.matmul(att.transpose(0, 2, 1), d, out=grads[:, :, 2 * WIDTH :])
        places, held = self.places[i], self.held[i].tolist()
        rows = grads.reshape(-1, 3 * WIDTH).take(places, 0)
        g, at = rows[: held[0]], held[0]
        for n in held[1:APART]:
            g[:n] += rows[at : at + n]
            at += n
        if at < len(rows):
            g[: held[APART]] += np.add.reduceat(rows[at:].view(self.pair), self.late[i]).view(kind)  # two numbers at a time
        return self.seen[i].take(places[: held[0]]), g, loss / max(1, m)


def gradients(w, tables: Tables, x, before, target, opening) -> tuple[float, dict[str, np.ndarray]]:
    """Mean log loss of the targets, and its gradient. Padding (-1) doesn't count."""
    flat = _packed(w)
    weights, g = _views(flat, tables), np.zeros_like(flat)
    classes, rows, loss = Steps(tables, x, before, target, opening, len(x), flat.dtype.type).run(0, weights, g[weights[0].size :], True)
    table, *rest = _views(g, tables)
    table[classes] = rows
    return loss, dict(zip(("q", "k", "v", "first", "rest", "on", "r"), [*np.split(table, 3, 1), *rest], strict=True))


def train(w, tables: Tables, windows: np.ndarray, rate: float, batch: int = 64, seed: int = 1) -> dict[str, np.ndarray]:
    """One pass of Adam over windows."""
    flat = _packed(w)
    m, s, change, tail = np.zeros_like(flat), np.zeros_like(flat), np.empty_like(flat), np.empty(flat.size - CLASSES * 3 * WIDTH, flat.dtype)
    views, (m_rows, *_), (s_rows, *_) = (_views(y, tables) for y in (flat, m, s))
    m_tail, s_tail = m[m_rows.size :], s[s_rows.size :]
    order = np.random.default_rng(seed).permutation(len(windows))
    steps, full, since = -(-len(order) // batch), len(order) // batch, 0
    for i in range(steps):
        at = i % PREPARED
        if not at or i == full:
            size = batch if i < full else len(order) - full * batch
            before, x, target, opening = unpacked(windows[order[i * batch : i * batch + size * min(PREPARED, max(1, full - i))]])
            at, ahead = 0, Steps(tables, x, before, target, opening, size, flat.dtype.type)
            m *= np.float32(0.9**since)
            s *= np.float32(0.99**since)
            since = 0
        classes, g, _ = ahead.run(at, views, tail)
        since += 1  # m and s stand for themselves times these powers, so only rows with a gradient change
        m_share, s_share = 0.9**since, 0.99**since
        for g, m_at, s_at, own in ((g, m_rows, s_rows, classes), (tail, m_tail, s_tail, None)):
            now = g * np.float32(0.1 / m_share)
            g *= g
            g *= np.float32(0.01 / s_share)
            if own is None:
                m_at += now
                s_at += g
            else:
                now += m_at.take(own, 0)
                g += s_at.take(own, 0)
                m_at[own], s_at[own] = now, g
        root = math.sqrt((1 - 0.99 ** (i + 1)) / s_share)
        now = (rate * (1 - i / steps) + rate * 0.05) / (1 - 0.9 ** (i + 1)) * m_share * root
        np.sqrt(s, out=change)
        change += np.float32(1e-8 * root)
        np.divide(m, change, out=change)
        change *= np.float32(now)
        flat -= change
    table, *rest = views
    return {k: v.copy() for k, v in zip(("q", "k", "v", "first", "rest", "on", "r"), [*np.split(table, 3, 1), *rest], strict=True)}


SEGMENT = 32 * BLOCK  # subwords of one text that training draws together


def segments(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each segment of texts, the block before it included unless the text begins there; the segment's text and its
    number in it."""
    n = -(-np.diff(offsets) // SEGMENT)
    text = np.repeat(np.arange(len(n)), n)
    number = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    start = offsets[text] + number * SEGMENT
    return np.where(number > 0, start - BLOCK, start), np.minimum(start + SEGMENT, offsets[text + 1]), text, number


def windows_of(classes: np.ndarray, ends: np.ndarray, leads: np.ndarray) -> np.ndarray:
    """Training windows, a row for each block of segments that lie end to end: inputs of the block before, inputs of the block, its
    last target, the number of targets, and whether the block opens a text. leads: the class before each segment, -1 if a text
    begins there; then no block stands before."""
    offsets = np.concatenate([[0], ends])
    x, target, opening = blocks(classes, offsets)
    x[opening, 0] = np.maximum(leads, END_CLASS)
    context = opening.copy()
    context[opening] = leads >= 0
    opening &= ~context
    take = np.flatnonzero(~context)
    before = befores(x, opening)
    n = (target[take] >= 0).sum(1)
    return np.concatenate([before[take], x[take], target[take, n - 1][:, None], n[:, None], opening[take, None]], 1).astype(np.int16)


def unpacked(windows: np.ndarray):
    """Inputs before, inputs, targets and openings of windows."""
    w = windows.astype(np.int64)
    before, x, last, n, opening = w[:, :BLOCK], w[:, BLOCK : 2 * BLOCK], w[:, 2 * BLOCK], w[:, 2 * BLOCK + 1], w[:, 2 * BLOCK + 2] > 0
    target = np.concatenate([x[:, 1:], last[:, None]], 1)
    target[np.arange(len(w)), n - 1] = last
    target[np.arange(BLOCK) >= n[:, None]] = -1
    return before, x, target, opening
