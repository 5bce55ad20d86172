"""Vectorised word splitting and hashing over UTF-8 bytes.

Every byte of a multi-byte character is at least 0x80, so word classes that
hold all non-ASCII characters can be decided byte by byte.
"""

from __future__ import annotations

import numpy as np

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]`, after A-Z became lower case.
WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = WORD[0x80:] = True
#: `[^\x20\x09-\x0D]`
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[0x20] = NOT_SPACE[0x09:0x0E] = False

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers = np.ones(1, np.uint64)


def _powers_to(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            more = np.full(max(n, 64), _BASE, np.uint64)
            more[0] = 1
            _powers = np.multiply.accumulate(more)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def split(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, cut: np.ndarray | None = None):
    """Starts, ends and rows of the words of all texts; none crosses a text's end.

    ``cut`` marks the bytes at which a new word begins even inside of one."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = is_word[data]
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    before[edges] = False
    if cut is not None:
        before &= ~cut
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = False, inside[1:]
    after[edges[edges > 0] - 1] = False
    if cut is not None:
        after[:-1] &= ~cut[1:]
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    first = np.cumsum(size) - size
    rank = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(first, size)
    at = np.repeat(starts, size) + rank
    with np.errstate(over="ignore"):
        term = (data[at].astype(np.uint64) + np.uint64(1)) * _powers_to(int(size.max()) + 1)[rank]
        return mix(np.add.reduceat(term, first) ^ size.astype(np.uint64))


def windows(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` words that follow one another (rows ignored)."""
    k = len(word_hashes) - n + 1
    if k <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = word_hashes[:k].copy()
        for j in range(1, n):
            out *= _BASE
            out += word_hashes[j : j + k]
        return mix(out)


class Numbering:
    """Open-addressing table from 64-bit hashes to numbers, probed in numpy."""

    def __init__(self, bits: int = 16):
        self.keys, self.numbers, self.size = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32), 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash, or -1."""
        mask = np.uint64(len(self.keys) - 1)
        h = np.where(h == 0, np.uint64(1), h)
        out, slot = np.full(len(h), -1, np.int32), (h & mask).astype(np.int64)
        got = self.keys[slot]
        hit = got == h
        out[hit] = self.numbers[slot[hit]]
        at = np.flatnonzero(~hit & (got != 0))
        while len(at):
            slot[at] = (slot[at] + 1) & int(mask)
            got = self.keys[slot[at]]
            hit = got == h[at]
            out[at[hit]] = self.numbers[slot[at[hit]]]
            at = at[~hit & (got != 0)]
        return out

    def add(self, h: np.ndarray, numbers: np.ndarray) -> None:
        """New distinct hashes and their numbers."""
        if 2 * (self.size + len(h)) > len(self.keys):
            old = self.keys != 0
            keys, values = self.keys[old], self.numbers[old]
            bits = int(4 * (self.size + len(h))).bit_length()
            self.__init__(bits)
            self.add(keys, values)
        self.size += len(h)
        mask = len(self.keys) - 1
        h = np.where(h == 0, np.uint64(1), h)
        slot = (h & np.uint64(mask)).astype(np.int64)
        while len(h):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[free]
            mine = free & (self.keys[slot] == h)
            self.numbers[slot[mine]] = numbers[mine]
            h, numbers, slot = h[~mine], numbers[~mine], (slot[~mine] + 1) & mask
