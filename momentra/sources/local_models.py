"""Small local providers: feature hashing and token overlap. They fill the seams without any model file."""

from __future__ import annotations

import hashlib
import math
import re

_WORD = re.compile(r"\w+")


class HashingEncoder:
    """Signed feature hashing of words into a unit vector of ``dim`` components."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def _one(self, text: str) -> list[float]:
        v = [0.0] * self.dim
        for word in _WORD.findall(text.lower()):
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
            v[h % self.dim] += 1.0 if h >> 63 else -1.0
        n = math.sqrt(sum(x * x for x in v))
        return [x / n for x in v] if n else v

    def encode_text(self, texts: list[str]) -> list[list[float]]:
        return [self._one(t) for t in texts]

    def encode_image(self, images: list[bytes]) -> list[list[float]]:
        return [self._one(i.hex(" ", 2)) for i in images]


class OverlapReranker:
    """Share of the query's words that an item holds."""

    def score(self, query: str, items: list[str]) -> list[float]:
        asked = set(_WORD.findall(query.lower()))
        return [len(asked & set(_WORD.findall(i.lower()))) / max(1, len(asked)) for i in items]
