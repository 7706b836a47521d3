"""Arrays of integers in few bytes: blobs that Spark shuffles as one row."""

from __future__ import annotations

import struct

import numpy as np


def pack(*columns: tuple[np.ndarray, int]) -> bytes:
    """Columns of (non-negative integers, bytes to keep of each), byte plane by byte plane: planes of zeros compress to nothing."""
    out = [struct.pack("<B", len(columns))]
    for values, width in columns:
        raw = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)
        out += [struct.pack("<QB", len(values), width), np.ascontiguousarray(raw[:, :width].T).tobytes()]
    return b"".join(out)


def unpack(blob: bytes) -> list[np.ndarray]:
    """The columns, as uint64."""
    out, at = [], 1
    for _ in range(blob[0]):
        n, width = struct.unpack_from("<QB", blob, at)
        at += 9
        raw = np.zeros((n, 8), np.uint8)
        raw[:, :width] = np.frombuffer(blob, np.uint8, n * width, at).reshape(width, n).T
        out.append(raw.view("<u8").ravel().astype(np.uint64))
        at += n * width
    return out


def stacked(blobs: list[bytes]) -> list[list[np.ndarray]]:
    """Column by column, the arrays of each blob."""
    return [list(c) for c in zip(*map(unpack, blobs), strict=True)]


def first_of_runs(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins, in sorted columns."""
    out = np.ones(len(keys[0]), bool)
    out[1:] = False
    for k in keys:
        out[1:] |= k[1:] != k[:-1]
    return out
