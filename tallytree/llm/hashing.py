"""Vectorised hashes of runs of values."""

from __future__ import annotations

import numpy as np

_MULTIPLIER = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits under which every bit depends on all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_MULTIPLIER, n, 1 << 64))


def rolled(values: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of ``length`` values, by doubling: no loop over positions."""
    have, size, out, done = values, 1, None, 0
    m = len(values) - length + 1
    for bit in range(length.bit_length()):
        if length >> bit & 1:
            piece = have[done : done + m]
            out = piece.copy() if out is None else out * _power(size) + piece
            done += size
        if length >> (bit + 1):
            have = have[:-size] * _power(size) + have[size:]
            size *= 2
    return out
