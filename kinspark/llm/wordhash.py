"""Words and byte spans of many texts at once, as 64-bit hashes, without a Python object for each word.

One running sum of byte codes times powers of an odd number gives the hash of any span in constant time, since an odd
number has an inverse modulo 2**64. Hashes depend on the bytes alone: not on where they stand, the process or the machine.
"""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240607)
CODES = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
_MIX = np.uint64(0xD6E8FEB86659FD93)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_WORD = np.ones(256, bool)  # ASCII other than letters and digits; bytes of other characters belong to words
NOT_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = 1 << int(n - 1).bit_length()
        up, down = np.full(size, BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        _powers = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _powers


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x ^= x >> np.uint64(29)
    x *= BASE
    return x ^ (x >> np.uint64(32))


def running(data: np.ndarray, codes: np.ndarray = CODES) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(codes[data] * powers(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of bytes start to end, for each pair."""
    return mixed((sums[end] - sums[start]) * powers(len(sums))[1][start] + (end - start).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word of texts that lie end to end, and where each text's words begin (n+1 places)."""
    inside = ~breaks[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = offsets[(offsets > 0) & (offsets < len(data))]  # a text's border ends a word
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offsets)
