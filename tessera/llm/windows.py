"""Numpy helpers for fixed-length windows over the symbols of one document.

A window of ``length`` symbols is found by its *anchor*: of the shorter grams that
lie in it, the one with the smallest hash (the leftmost of ties). Equal windows have
equal anchors at equal offsets, so only anchors, a few per window length, have to
meet other documents to find every window that can be repeated.
"""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64
_POS = U(28)  # bits of a position in a packed (hash, position)
_LOW = U((1 << 28) - 1)


def mix(a: np.ndarray, b: np.ndarray, lane: int = 0) -> np.ndarray:
    """A 64-bit hash of each pair; the lanes are independent of each other."""
    k1, k2 = ((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), (0xD6E8FEB86659FD93, 0xA0761D6478BD642F))[lane]
    x = (a ^ (a >> U(29))) * U(k1)
    y = (b ^ (b >> U(32))) * U(k2)
    x += (y << U(31)) | (y >> U(33))
    x ^= x >> U(29)
    x *= U(0x165667B19E3779F9)
    return x ^ (x >> U(32))


def gram_hash(codes: np.ndarray, length: int, lane: int = 0) -> np.ndarray:
    """Hash of ``codes[i : i + length]`` for every i, by doubling the length."""
    return _double(codes, 1, length, lane) if len(codes) >= length else np.empty(0, dtype=U)


def byte_hash(text: bytes, length: int, lane: int = 0) -> np.ndarray:
    """The same over bytes, from loads of eight bytes at every place."""
    if len(text) < length:
        return np.empty(0, dtype=U)
    if length < 8:
        return _double(np.frombuffer(text, dtype=np.uint8).astype(U), 1, length, lane)
    return _double(np.ndarray((len(text) - 7,), dtype="<u8", buffer=text, strides=(1,)).copy(), 8, length, lane)


def _double(h: np.ndarray, n: int, length: int, lane: int) -> np.ndarray:
    """From hashes of n symbols to those of ``length``."""
    while 2 * n <= length:
        h, n = mix(h[:-n], h[n:], lane), 2 * n
    return mix(h[: n - length], h[length - n :], lane) if n < length else h


def anchors(h: np.ndarray, grams: int) -> np.ndarray:
    """For each window of ``grams`` consecutive gram hashes, its anchor's position."""
    k = len(h) - grams + 1
    most = (1 << 28) - grams  # a position has 28 bits; longer texts go by parts
    if k > most:
        return np.concatenate([anchors(h[i : i + most + grams - 1], grams) + i for i in range(0, k, most)])
    m = ((h >> _POS) << _POS) | np.arange(len(h), dtype=U)
    n = 1
    while 2 * n <= grams:
        m, n = np.minimum(m[:-n], m[n:]), 2 * n
    if n < grams:
        m = np.minimum(m[:k], m[grams - n :][:k])
    return (m & _LOW).astype(np.int64)


def member(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which of ``values`` are in the sorted array ``of``."""
    if not len(of):
        return np.zeros(len(values), dtype=bool)
    at = np.searchsorted(of, values)
    at[at == len(of)] = 0
    return of[at] == values


def alone(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes at the distinct positions ``at``; those at more than one."""
    values, n = np.unique(h[np.unique(at)], return_counts=True)
    return values, values[n > 1]


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n symbols lie in a window that begins at one of ``starts``."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + length, -1)
    return np.cumsum(edge[:-1]) > 0


class WordCodes(dict):
    """Word -> 64-bit code, with a bounded memory of past words."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = code = xxhash.xxh64_intdigest(word)
        return code

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=U, count=len(words))
