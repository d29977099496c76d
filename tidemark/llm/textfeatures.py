"""Hashed character n-grams and words of whole texts, in numpy."""

from __future__ import annotations

import numpy as np

_M = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0x100000001B3)
_BACK = np.uint64(pow(0x100000001B3, -1, 1 << 64))
_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def mixed(h: np.ndarray, bits: int) -> np.ndarray:
    """The top bits of well-mixed 64-bit values."""
    h = h ^ (h >> np.uint64(29))
    h = h * _M
    h ^= h >> np.uint64(32)
    h *= _M
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def char_ngrams(c: np.ndarray, sizes: tuple[int, ...], bits: int) -> np.ndarray:
    """Buckets of all character n-grams of the code points c."""
    u = c.astype(np.uint64) + np.uint64(1)
    out, h, n = [], u, 1
    for size in range(2, max(sizes) + 1):
        if len(u) < size:
            break
        h = h[:-1] * _STEP + u[size - 1:]
        n = size
        if n in sizes:
            out.append(mixed(h + np.uint64(n * 0x51ED27), bits))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def words(c: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of code points that are not white space."""
    global _pow, _inv
    if not len(c):
        return np.zeros(0, np.uint64)
    if len(_pow) <= len(c):
        n = 1 << (len(c) + 1).bit_length()
        _pow = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _STEP, np.uint64)]), dtype=np.uint64)
        _inv = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _BACK, np.uint64)]), dtype=np.uint64)
    inside = np.zeros(len(c) + 2, bool)
    inside[1:-1] = (c > 32) & (c != 0xA0)
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    total = np.zeros(len(c) + 1, np.uint64)
    np.cumsum((c.astype(np.uint64) + np.uint64(1)) * _pow[: len(c)], dtype=np.uint64, out=total[1:])
    return (total[end] - total[start]) * _inv[start] + (end - start).astype(np.uint64) * _M


def first_of_each(h: np.ndarray, stamp: np.ndarray) -> np.ndarray:
    """The distinct values of h; stamp is an array over all values, reused."""
    i = np.arange(len(h), dtype=stamp.dtype)
    stamp[h] = i
    return h[stamp[h] == i]
