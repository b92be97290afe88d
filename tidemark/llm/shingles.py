"""Hashed word n-grams. 64-bit hashes stand for n-grams: two different ones are alike with chance 2^-64."""

from __future__ import annotations

import numpy as np

from .common import WordHashes

_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased words between the six ASCII separators, of the whole text."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def ngrams(words: list[bytes], n: int, hashes: WordHashes) -> np.ndarray:
    """Hash of the n-gram at each position; none if there are fewer words."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    out = np.full(m, n, np.uint64)
    for k in range(n):
        out = (out ^ h[k : k + m]) * _STEP
        out ^= out >> np.uint64(32)
    out *= _MIX
    return out ^ (out >> np.uint64(29))


def shingle_set(text: str | None, hashes: WordHashes, n: int = 5) -> np.ndarray:
    """Sorted distinct n-grams of a text; with fewer words the whole sequence is one; without words none."""
    words = words_of(text)
    return np.unique(ngrams(words, min(n, max(len(words), 1)), hashes))
