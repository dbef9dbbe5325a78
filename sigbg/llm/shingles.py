"""Word shingles of whole texts as 64-bit hashes, and b-bit minwise signatures over them."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

_P = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xFF51AFD7ED558CCD)
_M2 = np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)
CACHE_WORDS = 300_000
BLOCK = 8192


def mix64(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _S)) * _M1
    h = (h ^ (h >> _S)) * _M2
    return h ^ (h >> _S)


class Shingler:
    """Sets of ``k``-word shingles; A-Z lower-cased, words split at ASCII white space."""

    def __init__(self, k: int):
        self.k = k
        self.cache: dict[bytes, int] = {}

    def words(self, text: bytes) -> np.ndarray:
        w = text.lower().split()                    # bytes: A-Z only; space, \t \n \v \f \r only
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        c = self.cache
        for x in set(w).difference(c):
            c[x] = xxhash.xxh3_64_intdigest(x)
        return np.fromiter(map(c.__getitem__, w), dtype=np.uint64, count=len(w))

    def shingles(self, text: bytes) -> np.ndarray:
        """Sorted distinct shingle hashes; fewer than k words make one shingle, no words none."""
        w = self.words(text)
        if not len(w):
            return w
        k = min(self.k, len(w))
        n = len(w) - k + 1
        h = w[:n].copy()
        for i in range(1, k):
            h = h * _P + w[i:i + n]
        return np.unique(mix64(h))


def set_digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


class Signer:
    """``n_symbols`` minwise symbols of 16 bits for a set of shingle hashes."""

    def __init__(self, n_symbols: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 2 ** 63, n_symbols, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2 ** 63, n_symbols, dtype=np.uint64)

    def sign(self, shingles: np.ndarray) -> np.ndarray:
        low = np.full(len(self.a), 2 ** 64 - 1, dtype=np.uint64)
        for i in range(0, len(shingles), BLOCK):
            part = self.a[:, None] * shingles[None, i:i + BLOCK] + self.b[:, None]
            np.minimum(low, part.min(axis=1), out=low)
        return (mix64(low) >> np.uint64(48)).astype(np.uint16)
