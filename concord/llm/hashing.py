"""Vectorised hashing of byte strings: prefix sums give the hash of any substring in O(1).

The hash of bytes [s, e) is sum((b[j] + 1) * R**(j - s)) mod 2**64, put through a
finaliser.  It depends on content alone, so equal substrings of different documents,
batches and executors hash alike.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_R = 0x9E3779B97F4A7C15 | 5  # odd, and 5 mod 8: its powers run through the longest cycle
_R_INV = pow(_R, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1) mod 2**64, kept for the next call."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.full(size, base, U)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _POWERS[base] = have
    return have[:n]


class Prefix:
    """Prefix sums over one byte buffer."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, U)
        np.cumsum((data.astype(U) + U(1)) * powers(n, _R), out=self.sums[1:])
        self.inverse = powers(n + 1, _R_INV)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the substrings [start, end)."""
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])

    def all_of(self, length: int) -> np.ndarray:
        """Hashes of the substrings of this length at every start."""
        n = max(0, len(self.sums) - length)
        return mix((self.sums[length : length + n] - self.sums[:n]) * self.inverse[:n])
