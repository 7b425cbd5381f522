"""Polynomial hashes of substrings of a byte array, modulo 2**64, from prefix sums."""

from __future__ import annotations

import numpy as np

from riskweave.llm.textbytes import mix64

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1)."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 12, 1 << (n - 1).bit_length())
        have = np.full(size, base & (1 << 64) - 1, np.uint64)
        have[0] = 1
        _powers[base] = have = np.cumprod(have, dtype=np.uint64)
    return have[:n]


class PrefixHash:
    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(BASE, n), out=self.sums[1:])
        self.n = n

    def windows(self, size: int) -> np.ndarray:
        """Hash of data[i : i + size] for each i."""
        m = max(0, self.n - size + 1)
        return mix64((self.sums[size:] - self.sums[: self.n + 1 - size]) * _power(INVERSE, m)) if m else np.zeros(0, np.uint64)

    def spans(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of data[begin[i] : end[i]] for each i; the length counts."""
        raw = (self.sums[end] - self.sums[begin]) * _power(INVERSE, self.n + 1)[begin]
        return mix64(raw + (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
