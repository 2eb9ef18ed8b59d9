"""Word shingles as 64-bit hashes: words are lower-cased runs of non-white-space, a shingle is a
run of `width` consecutive words. Helpers for code that runs inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

from barloom.llm.pieces import UnitCache

MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode().split() if text else []


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of uint64 values (splitmix64)."""
    x = x + np.uint64(MIX[0])
    x ^= x >> np.uint64(30)
    x *= np.uint64(MIX[1])
    x ^= x >> np.uint64(27)
    x *= np.uint64(MIX[2])
    x ^= x >> np.uint64(31)
    return x


class WordHashes:
    """64-bit hashes of words, through a bounded cache."""

    def __init__(self, most: int = 400_000):
        self.cache = UnitCache(most)

    def hash(self, docs: list[list[bytes]]) -> list[np.ndarray]:
        self.cache.start()
        self.cache.fill(set().union(*docs), lambda new: map(xxhash.xxh3_64_intdigest, new))
        get = self.cache.__getitem__
        return [np.fromiter(map(get, d), np.uint64, len(d)) for d in docs]


def shingle_hashes(words: np.ndarray, width: int = 5) -> np.ndarray:
    """One hash for each run of `width` words; none where there are fewer words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out += words[k : k + n]
        out *= np.uint64(MIX[1])
        out ^= out >> np.uint64(29)
    return mixed(out)
