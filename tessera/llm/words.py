"""Words of many texts as arrays of 64-bit hashes, without a Python object a word.

Texts are laid out as one array of UTF-8 bytes. A word's hash adds up, over its bytes, a random number for each (place,
byte), so it is tabulation hashing up to TABLE_BYTES; longer words are hashed by xxhash. The numbers are a fixed
function of their index: all tasks, and all runs, give a word the same hash.
"""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64
MIX_1, MIX_2, MIX_3 = (U(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
TABLE_BYTES = 64
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> U(30))) * MIX_2
    x = (x ^ (x >> U(27))) * MIX_3
    return x ^ (x >> U(31))


_TABLES = [mix(mix(np.arange(TABLE_BYTES * 256, dtype=U) * MIX_1 + U(salt)) + MIX_1) for salt in (1, 2)]


class Words:
    """The words of some texts: `sizes` (words of each text), `raw` (all bytes), `begin` and `end` of each word, and hashes."""

    def __init__(self, some: list[str] = ()):
        self.read(some)

    def read(self, some: list[str]):
        parts = [t.encode("utf-8", "surrogatepass") for t in some]
        self.raw = b"\n".join(parts) + b"\n"
        flat = np.frombuffer(self.raw, np.uint8)
        space = _IS_SPACE[flat]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edge = np.concatenate(([0], edge))
        self.begin, self.end = edge[::2], edge[1::2]
        self.length = self.end - self.begin
        stops = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
        self.sizes = np.diff(np.searchsorted(self.begin, stops), prepend=0)
        n = len(self.begin)
        self.first = np.cumsum(self.length) - self.length  # of each word, among the bytes of words
        step = np.ones(int(self.length.sum()), np.int32)
        if n:
            step[0] = 0
            step[self.first[1:]] = 1 - self.length[:-1]
        place = np.cumsum(step, dtype=np.int32)
        place &= TABLE_BYTES - 1
        place <<= 8
        place += flat[~space]
        self.cell = place

    def hashes(self, second: bool = False) -> np.ndarray:
        """One of two independent hashes of each word."""
        if not len(self.begin):
            return np.zeros(0, U)
        h = np.add.reduceat(_TABLES[second][self.cell], self.first)
        h += self.length.astype(U) * MIX_3
        for k in np.flatnonzero(self.length > TABLE_BYTES):
            d = xxhash.xxh3_128_intdigest(self.raw[self.begin[k] : self.end[k]])
            h[k] = d >> 64 if second else d & 0xFFFFFFFFFFFFFFFF
        return mix(h)


def hash_of(words: list[str]) -> np.ndarray:
    """The first hash of each of some words (without white space inside)."""
    return Words([" ".join(words)]).hashes()


def chunks(some: list[str], chars: int):
    """(first, past-last) of runs of texts with about `chars` characters; a text is never cut."""
    at, n = 0, 0
    for k, t in enumerate(some):
        n += len(t)
        if n >= chars:
            yield at, k + 1
            at, n = k + 1, 0
    if at < len(some):
        yield at, len(some)
