"""Hashes of words and word windows as NumPy arrays, for operators that run in Arrow batches."""

from __future__ import annotations

import hashlib

import numpy as np

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Vocabulary(dict):
    """64-bit hashes of words (bytes), kept for words seen before. It is emptied at ``most`` words, so memory is bounded."""

    def __init__(self, most: int = 300_000) -> None:
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        self[word] = h
        return h

    def hashes(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(ids: np.ndarray, k: int) -> np.ndarray:
    """A hash of each window of ``k`` words, in order; empty if there are fewer words."""
    n = len(ids) - k + 1
    if n < 1:
        return np.empty(0, np.uint64)
    h = mix64(ids[:n] + np.uint64(k))
    for j in range(1, k):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + ids[j : n + j])
    return h


def shingles(words: list[bytes], k: int, vocabulary: Vocabulary) -> np.ndarray:
    """The sorted set of hashes of ``k``-word windows; the whole sequence as one if it is shorter; empty without words."""
    ids = vocabulary.hashes(words)
    if not len(ids):
        return ids
    h = mixed(ids, k) if len(ids) >= k else mixed(ids, len(ids))
    return np.unique(h)
