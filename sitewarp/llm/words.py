"""Words and their hashes, shared by the operators that compare texts."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")
_CACHE: dict[str, int] = {}
_CACHE_LIMIT = 1 << 20
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)


def words(text: str) -> list[str]:
    """Runs of letters and digits, in lower case."""
    return WORD.findall(text.lower())


def word_hashes(tokens: list[str]) -> np.ndarray:
    """64-bit hashes of words. A bounded cache holds the frequent ones; it only saves time."""
    if len(_CACHE) > _CACHE_LIMIT:
        _CACHE.clear()
    get = _CACHE.get
    out = [get(t) for t in tokens]
    if None in out:
        for i, h in enumerate(out):
            if h is None:
                out[i] = _CACHE[tokens[i]] = xxhash.xxh3_64_intdigest(tokens[i])
    return np.array(out, dtype=np.uint64)


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(29))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``size`` consecutive words; empty for shorter texts."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        total = scramble((total + hashes[k : k + n]) * _MIX[k % len(_MIX)])
    return np.unique(total)
