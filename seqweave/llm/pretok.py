"""Pre-tokens of byte-level BPE, in numpy over code points, and what is worked out once for each distinct one.

The split is that of the pattern  's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
Every rule of it looks at runs of one class (letter, number, white space, other) and their neighbours,
so the starts of all pre-tokens of a batch come from a few passes over arrays.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np

from .words import mix, range_hash

LETTER, NUMBER, SPACE, OTHER = range(4)
#: White space of the pattern's \\s beyond the categories Zs, Zl, Zp.  Fixed values.
CONTROL_SPACE = (9, 10, 11, 12, 13, 0x85)
#: Letters and numbers that Unicode 16 added to the tables of Python 3.13 (15.1); the tokenizer knows them.  Fixed values.
NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11380, 0x11389), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NEW_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
MOST_CACHED = 1_200_000
#: Characters of the pre-tokens that are kept, and the most that one of them has.
MOST_CHARS = 24_000_000
LONG = 256


@cache
def classes() -> np.ndarray:
    """The class of each code point."""
    kind = {"L": LETTER, "N": NUMBER}
    out = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        category = unicodedata.category(chr(c))
        if category[0] in kind:
            out[c] = kind[category[0]]
        elif category in ("Zs", "Zl", "Zp") or c in CONTROL_SPACE:
            out[c] = SPACE
    for ranges, new in ((NEW_LETTERS, LETTER), (NEW_NUMBERS, NUMBER)):
        for low, high in ranges:
            out[low : high + 1] = new
    return out


@dataclass
class Pretokens:
    distinct: list[str]
    which: np.ndarray  # of each pre-token, its place in distinct
    first: np.ndarray  # n + 1 offsets of the texts' pre-tokens


def starts(cp: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """True where a pre-token begins.  segment: the offsets of texts, between which nothing joins."""
    n = len(cp)
    kind = classes()[cp]
    border = np.zeros(n + 4, bool)  # a text begins here, or all have ended
    border[segment] = True
    border[n:] = True
    begin = np.zeros(n + 4, bool)
    begin[:n] = border[:n]
    begin[1:n] |= kind[1:] != kind[:-1]
    # The last of white space before other text stands alone or, if it is a blank, goes with that text.
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~border[1:n]) if n > 1 else np.zeros(0, np.int64)
    begin[last] = True
    begin[last[cp[last] == 32] + 1] = False
    # Contractions: an apostrophe that no blank precedes and a letter follows.
    quote = np.flatnonzero(cp == 39)
    quote = quote[begin[quote] & begin[quote + 1] & ~border[quote + 1]]
    ahead = np.concatenate([cp, np.zeros(4, cp.dtype)])
    one, two = ahead[quote + 1], ahead[quote + 2]
    short = np.isin(one, [ord(x) for x in "stmd"])
    long = ~border[quote + 2] & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
    begin[quote[short | long] + 1] = False
    begin[quote[short] + 2] = True
    begin[quote[long] + 3] = True
    return begin[:n]


def pretokens(texts: Sequence[str | None], special: re.Pattern | None = None) -> Pretokens:
    """The pre-tokens of texts; null counts as empty.  A match of `special` is one by itself."""
    pieces: list[str] = []
    alone: list[int] = []
    counts = []
    for text in texts:
        text = text or ""
        before = len(pieces)
        if special is not None and special.search(text):
            at = 0
            for m in special.finditer(text):
                pieces += [text[at : m.start()], m[0]]
                alone.append(len(pieces) - 1)
                at = m.end()
            pieces.append(text[at:])
        else:
            pieces.append(text)
        counts.append(len(pieces) - before)
    whole = "".join(pieces)
    cp = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(cp):
        return Pretokens([], np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64))
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
    begin = starts(cp, bounds[bounds < len(cp)])
    for k in alone:
        begin[bounds[k] + 1 : bounds[k + 1]] = False
    start = np.flatnonzero(begin)
    end = np.append(start[1:], len(cp))
    _, one, which = np.unique(range_hash(mix(cp.astype(np.uint64) + np.uint64(1)), start, end), return_index=True, return_inverse=True)
    distinct = [whole[a:b] for a, b in zip(start[one].tolist(), end[one].tolist(), strict=True)]
    docs = bounds[np.concatenate([[0], np.cumsum(counts)])]
    return Pretokens(distinct, which, np.searchsorted(start, docs))


class Memo:
    """Lists of numbers for distinct pre-tokens, kept while a Python worker lives; emptied at MOST_CACHED pre-tokens or MOST_CHARS characters.

    Those of more than LONG characters, which seldom come again, are held for one call.
    """

    def __init__(self, make: Callable[[list[str]], list[Sequence[int]]], most: int = MOST_CACHED, chars: int = MOST_CHARS):
        self.make, self.most, self.most_chars = make, most, chars
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.start = np.zeros(1 << 16, np.int64)
        self.size = np.zeros(1 << 16, np.int64)
        self.used = self.chars = 0

    def put(self, new: list[str], count: int) -> int:
        """Works out the numbers of new pre-tokens and places them from `count` on, after what is in use; returns how many numbers they have."""
        lists = self.make(new)
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        total = int(sizes.sum())
        while len(self.flat) < self.used + total:
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.start) < count + len(new):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(lists), np.int32, total)
        self.start[count : count + len(new)] = self.used + np.cumsum(sizes) - sizes
        self.size[count : count + len(new)] = sizes
        return total

    def places(self, distinct: list[str]) -> np.ndarray:
        if len(self.at) + len(distinct) > self.most or self.chars > self.most_chars:
            self.clear()
        new = [x for x in distinct if x not in self.at]
        long = [x for x in new if len(x) > LONG]
        if long:
            new = [x for x in new if len(x) <= LONG]
        if new:
            count = len(self.at)
            self.used += self.put(new, count)
            self.chars += sum(map(len, new))
            self.at.update(zip(new, range(count, count + len(new)), strict=True))
        if not long:
            return np.fromiter(map(self.at.__getitem__, distinct), np.int64, len(distinct))
        self.put(long, len(self.at))  # the next call writes over them
        once = dict(zip(long, range(len(self.at), len(self.at) + len(long)), strict=True))
        return np.fromiter((self.at[x] if x in self.at else once[x] for x in distinct), np.int64, len(distinct))

    def ragged(self, p: Pretokens) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all texts in a row, and the n + 1 offsets of the texts."""
        if not p.distinct:
            return np.zeros(0, np.int32), np.zeros_like(p.first)
        place = self.places(p.distinct)[p.which]
        size = self.size[place]
        ends = np.cumsum(size)
        inside = np.arange(ends[-1]) - np.repeat(ends - size, size)
        return self.flat[np.repeat(self.start[place], size) + inside], np.concatenate([[0], ends])[p.first]
