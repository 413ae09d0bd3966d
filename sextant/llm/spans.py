"""Text as arrays: code points, classes, spans and their hashes, in numpy.

Small helpers that run inside tasks. A chunk of texts becomes one array of
code points with a separator after each text; words or tokens are spans of
it; equal spans have equal hashes, so that each distinct one is worked on once.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd

#: Class of the separator, letters, numbers, white space and all others.
END, LETTER, NUMBER, SPACE, OTHER = range(5)
SEPARATOR = 0x110000
#: Code points that a chunk holds unless one text is longer.
CHUNK = 400_000
#: Spans longer than this are hashed by digest.
LONG = 256
#: Distinct spans that a worker remembers before it starts anew.
REMEMBERED = 1_000_000
_BASE = 0x9E3779B97F4A7C15
_SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@cache
def classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(SEPARATOR)), np.uint8, SEPARATOR)
    table = np.append(table, np.uint8(END))
    table[_SPACES] = SPACE
    return table


@cache
def lowered() -> np.ndarray:
    """Lower case by code point; those whose lower case is longer stay."""
    low = (c.lower() for c in map(chr, range(SEPARATOR)))
    return np.append(np.fromiter((ord(x) if len(x) == 1 else i for i, x in enumerate(low)), np.uint32, SEPARATOR), np.uint32(SEPARATOR))


def chunks(texts: Iterable[str]) -> Iterator[list[str]]:
    """Runs of texts of about CHUNK code points; a longer text is alone."""
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > CHUNK:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text) + 1
    if held:
        yield held


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points with a separator after each text, and where each text starts."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    starts = np.concatenate(([0], np.cumsum(lengths)))
    codes = np.full(starts[-1], SEPARATOR, np.uint32)
    keep = np.ones(len(codes), bool)
    keep[starts[1:] - 1] = False
    codes[keep] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, starts


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Prefixes:
    """64-bit hashes of spans of one array: polynomial in the values, by prefix sums."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = values
        up, self.down = _powers(1 << int(len(values)).bit_length())
        mixed = (values.astype(np.uint64) + np.uint64(0x51)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        mixed *= up[: len(values)]
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed)))

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        lengths = ends - starts
        found = (self.sums[ends] - self.sums[starts]) * self.down[starts] + lengths.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
        found ^= found >> np.uint64(31)
        found *= np.uint64(0xBF58476D1CE4E5B9)
        for i in np.flatnonzero(lengths > LONG):
            found[i] = int.from_bytes(hashlib.blake2b(self.values[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
        return found


def hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return Prefixes(values).of(starts, ends)


class Remembered:
    """Arrays by span: what ``make`` gives for each distinct span is kept, up to a bound."""

    def __init__(self, dtype: type = np.int32) -> None:
        self.dtype = dtype
        self.clear()

    def clear(self) -> None:
        self.known, self.slot_of = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # by hash, ascending
        self.flat, self.used, self.count = np.zeros(1 << 16, self.dtype), 0, 0
        self.offsets, self.sizes = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)

    def _room(self, name: str, needed: int) -> np.ndarray:
        old = getattr(self, name)
        if needed > len(old):
            new = np.zeros(max(needed, len(old) * 3 // 2), old.dtype)
            new[: len(old)] = old
            setattr(self, name, new)
        return getattr(self, name)

    def find(self, hashed: np.ndarray, make: Callable[[np.ndarray], list]) -> np.ndarray:
        """The slot of each span. ``make`` gets positions of spans not seen before."""
        if self.count > REMEMBERED:
            self.clear()
        which, distinct = pd.factorize(hashed)
        at = np.searchsorted(self.known, distinct)
        seen = np.zeros(len(distinct), bool)
        inside = at < len(self.known)
        seen[inside] = self.known[at[inside]] == distinct[inside]
        slots = np.zeros(len(distinct), np.int64)
        slots[seen] = self.slot_of[at[seen]]
        new = np.flatnonzero(~seen)
        if len(new):
            first = np.zeros(len(distinct), np.int64)
            first[which[::-1]] = np.arange(len(which) - 1, -1, -1)
            made = make(first[new])
            n, start = len(new), self.count
            sizes = np.fromiter(map(len, made), np.int64, n)
            total = int(sizes.sum())
            flat = np.concatenate(made) if isinstance(made[0], np.ndarray) else np.fromiter((x for m in made for x in m), self.dtype, total)
            self._room("flat", self.used + total)[self.used : self.used + total] = flat
            self._room("offsets", start + n)[start : start + n] = self.used + np.cumsum(sizes) - sizes
            self._room("sizes", start + n)[start : start + n] = sizes
            slots[new] = np.arange(start, start + n)
            self.used, self.count = self.used + total, start + n
            by = np.argsort(distinct[new])
            into = at[new][by]
            self.known, self.slot_of = np.insert(self.known, into, distinct[new][by]), np.insert(self.slot_of, into, slots[new][by])
        return slots[which]

    def expand(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The kept arrays of the slots one after another, and their sizes."""
        sizes = self.sizes[slots].astype(np.int64)
        ends = np.cumsum(sizes)
        if not len(ends):
            return np.zeros(0, self.dtype), sizes
        at = np.repeat(self.offsets[slots] - (ends - sizes), sizes) + np.arange(ends[-1])
        return self.flat[at], sizes


def word_spans(kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of letters."""
    letter = np.concatenate(([False], kinds == LETTER, [False]))
    turns = np.flatnonzero(letter[1:] != letter[:-1])
    return turns[::2], turns[1::2]


def token_starts(codes: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Where the byte-level pre-tokenizer's pieces start, as a mask.

    The pieces are: a contraction ('s 't 're 've 'm 'll 'd), or an optional
    blank and a run of letters, of numbers or of other marks, or white space
    without the last one before such a run, or that one if it is no blank.
    """
    n = len(codes)
    start = np.ones(n + 4, bool)  # room to look ahead
    start[1:n] = kinds[1:] != kinds[:-1]
    start[:n] |= kinds == END
    # white space: its last character before a visible one starts a piece, a blank joins what follows
    space = kinds == SPACE
    last = np.flatnonzero(space[:-1] & ~space[1:] & (kinds[1:] != END))
    start[last] = True
    joined = last[codes[last] == 0x20] + 1
    start[joined] = False
    # contractions
    quote = np.flatnonzero(codes == 0x27)
    quote = quote[start[quote]]
    if len(quote):
        ahead = np.concatenate((codes, np.full(4, SEPARATOR, np.uint32)))
        one, two = ahead[quote + 1], ahead[quote + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for hit, size in ((quote[short], 2), (quote[long], 3)):
            start[hit + 1] = False
            start[hit + size] = True
    return start[:n]
