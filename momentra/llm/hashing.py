"""Vectorised 64-bit hashes of words and word windows (numpy, no per-word Python).

A word is a maximal run of bytes outside ``\\x20\\x09-\\x0D`` of the UTF-8 text, so hashes of equal
words are equal however they are spaced.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE, _MIX1, _MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_SEGMENT = 1 << 20
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: spreads every input bit over all 64."""
    x = x ^ (x >> U(30))
    x = x * U(_MIX1)
    x = x ^ (x >> U(27))
    x = x * U(_MIX2)
    return x ^ (x >> U(31))


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, _SEGMENT + 4096), base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.cumprod(have, dtype=np.uint64)
    return have


def words(buffer: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte offsets and a 64-bit hash of every word of ``buffer``, in order.

    Works through segments of about a megabyte that end at white space, so memory beside the
    result stays bounded for any text length (but for a single word longer than that).
    """
    data = np.frombuffer(buffer, np.uint8)
    starts, ends, hashes, at = [], [], [], 0
    while at < len(data):
        stop = min(len(data), at + _SEGMENT)
        while stop < len(data) and not _SPACE[data[stop]]:
            stop += 1
        part = data[at:stop]
        space = _SPACE[part]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
        s, e = edge[0::2], edge[1::2]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + U(1)) * _power(_BASE, len(part))[: len(part)], out=total[1:])
        inverse = _power(pow(_BASE, -1, 1 << 64), len(part) + 1)
        hashes.append(mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64)))
        starts.append(s + at)
        ends.append(e + at)
        at = stop
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)


def windows(word_hash: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """A hash of each run of ``size`` consecutive word hashes; different salts are independent."""
    n = len(word_hash) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    step = U((_MIX2 + 2 * salt * _MIX1) & ((1 << 64) - 1) | 1)
    w = mix(word_hash + U(salt * _BASE & ((1 << 64) - 1))) if salt else word_hash
    total = w[:n].copy()
    with np.errstate(over="ignore"):
        for j in range(1, size):
            total *= step
            total += w[j : n + j]
    return mix(total)


class Texts:
    """The words of several texts at once: ``doc`` is the index of each word's text."""

    def __init__(self, texts: list[bytes]):
        self.buffer = b"\n".join(texts)
        lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.base = np.concatenate(([0], np.cumsum(lengths + 1)))[: len(texts)]
        self.start, self.end, self.hash = words(self.buffer)
        self.doc = np.searchsorted(self.base, self.start, side="right") - 1
        self.n_docs = len(texts)
        self.count = np.bincount(self.doc, minlength=self.n_docs) if self.n_docs else np.zeros(0, np.int64)

    def windows(self, size: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the windows within single texts and the index of each one's first word."""
        h = windows(self.hash, size, salt)
        at = np.flatnonzero(self.doc[: len(h)] == self.doc[size - 1 :][: len(h)])
        return h[at], at
