"""Words, lines and word windows of a batch of texts, in numpy over their UTF-8 bytes.

A word is a maximal run of bytes other than space and tab to carriage return.  Hashes are 64-bit:
a polynomial over random byte values for words, another over word hashes for windows, each with a final mix.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD6E8FEB86659FD93)
BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = 1 << max(10, int(n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.cumprod(have)
        _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def range_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of values[start:end] for each pair, which depends on the values alone."""
    if not len(start):
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(BASE, len(values)), out=sums[1:])
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    return mix((sums[end] - sums[start]) * powers(inverse, int(start.max()) + 1)[start] + (end - start).astype(np.uint64))


@dataclass
class Words:
    start: np.ndarray  # of each word, in the bytes
    end: np.ndarray
    doc: np.ndarray  # the text it belongs to
    first: np.ndarray  # n + 1 offsets of the texts' words


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    n = len(offsets) - 1
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(n + 1, np.int64))
    inside = ~SPACE[data]
    fresh = np.zeros(len(data) + 1, bool)
    fresh[offsets] = True  # a text starts anew
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | fresh[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | fresh[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(n), np.diff(first))
    return Words(start, end, doc, first)


def word_hashes(data: np.ndarray, w: Words) -> np.ndarray:
    return range_hash(BYTE[data], w.start, w.end)


def windows(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each window of `size` words inside one text, and the index of its first word."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out += hashes[k : k + n] * np.uint64(pow(int(STEP), k, 1 << 64))
    counts = np.diff(first)
    left = np.repeat(first[1:], counts)[:n] - np.arange(n)  # words from here to the end of the text
    at = np.flatnonzero(left >= size)
    return mix(out[at]), at


def code_points(data: np.ndarray) -> np.ndarray:
    """True for each byte that begins a code point."""
    return (data & 0xC0) != 0x80


def sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of flags in each range of the offsets."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[offsets])
