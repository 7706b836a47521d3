"""Sets of word shingles as sorted 64-bit hashes, for whole batches at once.

A-Z is lower-cased; words are ``[^\\x20\\x09-\\x0D]+``; a text of fewer words than a shingle
holds is one shingle; a text without words has the empty set.
"""

from __future__ import annotations

import numpy as np

from .hashing import Prefix, U, mix
from .packing import first_of_runs


def _fold() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[9:14] = 32
    return table


FOLD = _fold()


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, and the text of each; by text, then by hash."""
    none = np.zeros(0, U), np.zeros(0, np.int64)
    low = FOLD[data]
    blank = low == 32
    before = np.ones(len(low), bool)
    before[1:] = blank[:-1]
    before[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
    keep = ~(blank & before)
    if not keep.any():
        return none
    places = np.zeros(len(low) + 1, np.int64)
    np.cumsum(keep, out=places[1:])
    low, offsets = low[keep], places[offsets]
    blank = low == 32
    edge = np.zeros(len(low) + 1, bool)
    edge[offsets] = True
    starts = ~blank
    starts[1:] &= blank[:-1] | edge[1:-1]
    ends = ~blank
    ends[:-1] &= blank[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    doc = np.searchsorted(offsets, starts, "right") - 1
    first = np.flatnonzero(first_of_runs(doc))
    count = np.diff(np.append(first, len(doc)))
    last = np.arange(len(doc)) + size - 1
    short = count < size
    last[first[short]] = first[short] + count[short] - 1
    use = last < len(doc)
    use[use] = doc[last[use]] == doc[use]
    use &= (np.arange(len(doc)) + size - 1 == last) | np.isin(np.arange(len(doc)), first[short])
    hashes, doc = Prefix(low).of(starts[use], ends[last[use]]), doc[use]
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = first_of_runs(doc, hashes)
    return hashes[new], doc[new]


def sums(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Sums of uint64 values by place, modulo 2**64."""
    low = np.bincount(at, (values & U(0xFFFFFFFF)).astype(np.float64), n)
    high = np.bincount(at, (values >> U(32)).astype(np.float64), n)
    return low.astype(U) + (high.astype(U) << U(32))


def set_ids(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A 63-bit id of each set's content, and its size."""
    size = np.bincount(doc, minlength=n)
    return (mix(sums(mix(hashes), doc, n) + size.astype(U)) >> U(1)).astype(np.int64), size
