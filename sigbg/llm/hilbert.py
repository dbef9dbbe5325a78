"""Hilbert keys for points in a small number of dimensions, many points at once."""

from __future__ import annotations

import numpy as np


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of each row of ``points`` (n x dims integers below 2**bits).

    The transposed form of the curve: undo excess rotations from the highest
    bit down, Gray-decode, then interleave the bits of the dimensions.
    """
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    if dims * bits > 62:
        raise ValueError("the key must fit in 62 bits")
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            hit = (x[i] & q) != 0
            swap = np.where(hit, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(hit, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[dims - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key
