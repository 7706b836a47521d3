"""Encode each distinct piece of text once, and lay out the ids of whole texts with array operations.

A piece is known by a 64-bit hash of its bytes and length.  Two of the ``limit`` pieces that a
worker keeps share a hash with probability limit**2 / 2**65: 2e-8 for 800,000 pieces.  Pieces
are kept in sorted arrays, some 40 bytes each with their ids.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .hashing import Prefix, U, mix


class PieceCache:
    """``encode(data, begin, end) -> (ids, number of ids of each)`` is asked for new pieces only; it may give a flag of each piece too, which is kept with it."""

    def __init__(self, encode: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, ...]], dtype: np.dtype, limit: int = 800_000):
        self.encode, self.limit, self.dtype = encode, limit, dtype
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, U)  # sorted, with the place of each piece
        self.places = np.zeros(0, np.int32)
        self.flat = np.zeros(1 << 16, self.dtype)
        self.starts = np.zeros(1 << 14, np.int32)
        self.sizes = np.zeros(1 << 14, np.int32)
        self.flags = np.zeros(1 << 14, bool)
        self.used = 0

    def _learn(self, keys: np.ndarray, new: np.ndarray, sizes: np.ndarray, flags: np.ndarray | bool = False) -> None:
        """``keys`` are sorted and new."""
        n, more = len(self.keys), len(keys)
        while self.used + len(new) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while n + more > len(self.starts):
            self.starts, self.sizes, self.flags = (np.concatenate((x, np.zeros_like(x))) for x in (self.starts, self.sizes, self.flags))
        self.flat[self.used : self.used + len(new)] = new
        self.starts[n : n + more] = self.used + np.cumsum(sizes) - sizes
        self.sizes[n : n + more] = sizes
        self.flags[n : n + more] = flags
        self.used += len(new)
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.places = np.insert(self.places, at, np.arange(n, n + more, dtype=np.int32))

    def lookup(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of the pieces [begin, end) in order, the number of ids of each, and its flag."""
        if not len(begin):
            return self.flat[:0], np.zeros(0, np.int64), np.zeros(0, bool)
        keys = mix(Prefix(data).of(begin, end) + (end - begin).astype(U))
        distinct, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) + len(distinct) > self.limit:
            self._clear()
        at = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == distinct[inside]
        if not known.all():
            where = first[~known]
            self._learn(distinct[~known], *self.encode(data, begin[where], end[where]))
            at = np.searchsorted(self.keys, distinct)
        which = self.places[at][inverse]
        sizes = self.sizes[which].astype(np.int64)
        total = np.cumsum(sizes)
        return self.flat[np.repeat(self.starts[which] - (total - sizes), sizes) + np.arange(total[-1])], sizes, self.flags[which]


def per_row(begin: np.ndarray, offsets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of the pieces' sizes by row of the buffer."""
    total = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=total[1:])
    at = np.searchsorted(begin, offsets)
    return np.diff(total[at])
