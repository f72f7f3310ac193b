"""64-bit hashes of words and word n-grams, for whole Arrow text buffers at once.

A word is ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. Its hash is a polynomial over random byte
values, taken as a difference of prefix sums modulo 2**64 and then mixed, so a megabyte of text costs
a few numpy passes. Two different n-grams share a hash with a chance of 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import buffers, keep, slices

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
VALUES = np.random.Generator(np.random.PCG64(20240611)).integers(1, 2**63, 256, dtype=np.uint64)[LOWER]
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers (splitmix64's finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Powers:
    """Powers of the base and of its inverse; only those for a usual slice are kept."""

    def __init__(self) -> None:
        self.kept: tuple[np.ndarray, np.ndarray] | None = None

    @staticmethod
    def made(n: int) -> tuple[np.ndarray, np.ndarray]:
        up, down = np.full((2, n), 1, np.uint64)
        up[1:], down[1:] = BASE, INVERSE
        return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > 2 * CHUNK:  # a word that is longer than any slice
            return self.made(n)
        if self.kept is None:
            self.kept = self.made(2 * CHUNK)
            keep("powers", self.forget)
        return self.kept

    def forget(self) -> None:
        self.kept = None


POWERS = Powers()


def hash_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each text's words begin (one more entry than texts)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    up, down = POWERS.upto(n + 1)
    blank = SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    cut[n] = True
    first = ~blank
    first[1:] &= blank[:-1] | cut[1:n]
    last = ~blank
    last[:-1] &= blank[1:] | cut[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(VALUES[data] * up[:n], out=sums[1:])
    words = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return words, np.searchsorted(starts, offsets)


def long_words(data: np.ndarray, most_bytes: int) -> np.ndarray:
    """Hashes of all words of one long text, taken piece by piece; pieces end at blanks."""
    words, at = [], 0
    while at < len(data):
        end = at + most_bytes
        while end < len(data) and not (found := np.flatnonzero(SPACE[data[end : end + most_bytes]])).size:
            end += most_bytes
        end = end + int(found[0]) if end < len(data) else len(data)
        words.append(hash_words(data[at:end], np.array([0, end - at]))[0])
        at = end
    return np.concatenate(words)


def word_batches(column: pa.Array, most_bytes: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, word offsets by row) for slices of a text column; a longer text is read piece by piece."""
    for i, j in slices(column, most_bytes):
        data, offsets = buffers(column.slice(i, j - i))
        if j - i == 1 and len(data) > most_bytes:
            words = long_words(data, most_bytes)
            yield i, words, np.array([0, len(words)])
        else:
            yield i, *hash_words(data, offsets)


def shingle_sets(words: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Each text's distinct k-word shingles, as sorted hashes; a shorter text is one shingle, an empty one none."""
    sets = []
    if len(words) >= k:
        grams = words[: len(words) - k + 1].copy()
        for i in range(1, k):
            grams = grams * U(0xD6E8FEB86659FD93) + words[i : len(words) - k + 1 + i]
        grams = mix(grams)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= k:
            sets.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            h = U(b - a)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    h = h * U(0xA0761D6478BD642F) + w
            sets.append(mix(np.array([h], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets
