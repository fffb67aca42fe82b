"""Hashed word shingles of whole texts, for operators that run in Python workers."""

from __future__ import annotations

import numpy as np
import xxhash

_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)
EMPTY = np.empty(0, np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _Q
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of so many words, letters A-Z lower-cased.

    Words are runs of anything but ASCII white space.  A shorter text is one shingle as a whole; a text without
    words has none.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return EMPTY
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    k = min(words, len(h))
    n = len(h) - k + 1
    out = np.full(n, np.uint64(k), np.uint64)
    for i in range(k):
        out = mixed(out * _P + h[i : i + n])
    out.sort()
    return out[np.r_[True, out[1:] != out[:-1]]]


def multipliers(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(seed))
    a = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 1 << 63, n, dtype=np.uint64)


def minima(tokens: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of each hash function over the tokens, 32 bits of it; memory doesn't grow with the text."""
    best = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(tokens), 2048):
        part = tokens[i : i + 2048, None] * a + b
        part ^= part >> np.uint64(32)
        np.minimum(best, (part * _P).min(axis=0), out=best)
    return (best >> np.uint64(32)).astype(np.uint32)


def intersection(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())
