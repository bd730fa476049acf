"""Words of many texts at once: positions and 64-bit hashes, computed on the UTF-8 bytes with numpy.

A word is a longest run of bytes of a given class. The classes used here hold either all or none of the
bytes from 0x80 up, so cutting bytes is the same as cutting characters.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_CHUNK = 200_000  # words hashed in one step


def mix(x: np.ndarray) -> np.ndarray:
    """A published 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_INVERSE = pow(_BASE, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
LETTER_OR_DIGIT = np.zeros(256, bool)
LETTER_OR_DIGIT[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
NOT_LINE_END = np.ones(256, bool)
NOT_LINE_END[0x0A] = False


def _powers(base: int, n: int, kept: dict = {}) -> np.ndarray:  # noqa: B006  (kept between calls on purpose)
    if base not in kept or len(kept[base]) < n:
        values = np.full(max(n, 1 << 16), base, _U)
        values[0] = 1
        kept[base] = np.multiply.accumulate(values)
    return kept[base][:n]


@dataclass
class Words:
    """Where the words of several texts are; ``doc`` numbers the text of each word, ``first`` has n + 1 entries."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def cut(data: np.ndarray, begins: np.ndarray, inside: np.ndarray) -> Words:
    """Words of texts that lie one behind the other in ``data``; ``inside`` has the bytes that words consist of."""
    n = len(data)
    mask = inside[data]
    before = np.zeros(n, bool)
    before[1:] = mask[:-1]
    before[begins[:-1][begins[:-1] < n]] = False
    start = np.flatnonzero(mask & ~before)
    after = np.zeros(n, bool)
    after[:-1] = mask[1:]
    after[begins[1:][begins[1:] > 0] - 1] = False
    end = np.flatnonzero(mask & ~after) + 1
    first = np.searchsorted(start, begins)
    doc = np.repeat(np.arange(len(begins) - 1), np.diff(first))
    return Words(data, start, end, doc, first)


def hashes(words: Words) -> np.ndarray:
    """A 64-bit hash of the bytes of each word: a polynomial over random byte values, then mixed with the length."""
    out = np.empty(len(words.start), _U)
    for k in range(0, len(out), _CHUNK):
        start, end = words.start[k:k + _CHUNK], words.end[k:k + _CHUNK]
        low, high = int(start[0]), int(end[-1])
        sums = np.zeros(high - low + 1, _U)
        np.cumsum(_BYTE_VALUES[words.data[low:high]] * _powers(_BASE, high - low), out=sums[1:])
        h = (sums[end - low] - sums[start - low]) * _powers(_INVERSE, high - low + 1)[start - low]
        out[k:k + _CHUNK] = mix(h + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93))
    return out


def runs(values: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` consecutive values, in order; empty if there are fewer."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = np.zeros(n, _U)
    for k in range(size):
        out = out * _U(0xA0761D6478BD642F) + values[k:k + n]
    return mix(out)
