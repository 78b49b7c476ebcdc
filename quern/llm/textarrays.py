"""Texts as numpy arrays: code points, hashes of all k-grams, minima over sliding windows."""

from __future__ import annotations

import numpy as np

_ODD, _JOIN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def points_of(text: str) -> np.ndarray:
    """The code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that all bits of the result depend on all bits given."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def gram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k-gram, by joining hashes of doubling length."""
    n = len(points) - k + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    level, size = mix(points.astype(np.uint64) + _ODD), 1
    out, covered = None, 0
    factor = int(_ODD)
    left = k
    while True:
        if left & 1:
            part = level[covered : covered + n] if out is None else level[covered : covered + n] + out * _JOIN
            out, covered = part, covered + size
        left >>= 1
        if not left:
            return mix(out)
        level = level[:-size] * np.uint64(factor) + level[size:]
        factor = (factor * factor + 2) % (1 << 64)
        size *= 2


def rolling_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    m, size = values, 1
    while size * 2 <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    rest = width - size
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m
