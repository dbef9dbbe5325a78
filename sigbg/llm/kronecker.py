"""Exact inner products of integer vectors, several candidates to one multiplication (operator 11).

The components of several candidates are biased to be non-negative and laid
side by side into the fields of one wide integer, a field as wide as the
largest sum that can arise in it.  One multiplication by an anchor's component
then multiplies all of them, sums never run over into the next field, and the
fields of the result, less what the biases added, are the exact products.

Wide integers of up to 53 bits are held in doubles, whose multiply-adds are
exact there, so that the sums are one matrix product.  Vectors with very large
components use whole numbers of any width.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bits of an integer that a double holds exactly.
WORD_BITS = 53
#: Components beyond this go to the integers of any width.
LARGE = 1 << 20
#: Candidates in one integer of any width.
WIDE_FIELDS = 8
LONG = (1 << 63) - 1


def matrix(col: pa.ListArray, d: int) -> np.ndarray:
    """Rows of a list column as an int64 matrix of ``d`` columns; missing components are 0, further ones left out."""
    n = len(col)
    lens = np.diff(col.offsets.to_numpy()).astype(np.int64)
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    if n and (lens == d).all():
        return flat.reshape(n, d)
    out = np.zeros((n, d), dtype=np.int64)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
    row = np.repeat(np.arange(n), lens)
    fits = at < d
    out[row[fits], at[fits]] = flat[fits]
    return out


def field_bits(a: np.ndarray, c: np.ndarray) -> int:
    """Bits that hold any sum of products of rows of ``a`` and ``c`` (both biased to be non-negative)."""
    return max(1, (a.shape[1] * int(a.max(initial=0)) * int(c.max(initial=0))).bit_length())


def pack(c: np.ndarray, fields: int, bits: int, kind=np.float64) -> np.ndarray:
    """Words of ``fields`` rows of ``c`` each: row ``w * fields + k`` is field ``k`` of word ``w``."""
    words = -(-len(c) // fields)
    padded = np.zeros((words * fields, c.shape[1]), dtype=kind)
    padded[:len(c)] = c
    out = padded[0::fields].copy()
    for k in range(1, fields):
        out += padded[k::fields] * kind(1 << (bits * k)) if kind is np.float64 else padded[k::fields] * (1 << (bits * k))
    return out


def unpack(words: np.ndarray, n: int, fields: int, bits: int) -> np.ndarray:
    """(anchors, n) field values of (anchors, words) wide integers."""
    out = np.empty((words.shape[0], words.shape[1] * fields), dtype=words.dtype)
    mask = (1 << bits) - 1
    for k in range(fields):
        out[:, k::fields] = (words >> (bits * k)) & mask
    return out[:, :n]


def _packed(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact products of rows with components of at most LARGE, or any by the integers of any width."""
    d = a.shape[1]
    low_a, low_c = int(a.min(initial=0)), int(c.min(initial=0))
    big = max(int(a.max(initial=0)), int(c.max(initial=0)), -low_a, -low_c) > LARGE
    if big:
        a, c = a.astype(object), c.astype(object)
    up_a, up_c = a - low_a, c - low_c
    bits = field_bits(up_a, up_c)
    fields = WORD_BITS // bits
    if fields and not big:
        words = (up_a.astype(np.float64) @ pack(up_c, fields, bits).T).astype(np.int64)
    else:
        fields, up_a, up_c = WIDE_FIELDS, up_a.astype(object), up_c.astype(object)
        words = up_a @ pack(up_c, fields, bits, object).T
    raw = unpack(words, len(c), fields, bits)
    raw = raw + low_c * up_a.sum(axis=1)[:, None] + low_a * up_c.sum(axis=1)[None, :] + d * low_a * low_c
    return np.clip(raw, -LONG, LONG).astype(np.int64) if raw.dtype == object else raw


def scores(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """(len(a), len(c)) exact integer inner products; beyond the range of a long they stop at its ends."""
    if not len(a) or not len(c) or not a.shape[1]:
        return np.zeros((len(a), len(c)), dtype=np.int64)
    huge_a, huge_c = (np.maximum(x.max(axis=1), -x.min(axis=1)) > LARGE for x in (a, c))
    if not huge_a.any() and not huge_c.any():
        return _packed(a, c)
    out = np.empty((len(a), len(c)), dtype=np.int64)
    for ma in (huge_a, ~huge_a):
        for mc in (huge_c, ~huge_c):
            if ma.any() and mc.any():
                out[np.ix_(ma, mc)] = _packed(a[ma], c[mc])
    return out
