"""Hashes of many ranges of one array at once: sums of powers modulo 2**64, without a loop over the ranges."""

from __future__ import annotations

import numpy as np
import xxhash

_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
#: Values summed up at once, and the longest range that is hashed this way.
_STEP, _LONG = 1 << 22, 255

_made: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n - 1), modulo 2**64."""
    if len(_made.get(base, ())) < n:
        out = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        out[:1] = 1
        _made[base] = np.multiply.accumulate(out)
    return _made[base][:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each values[start:end]; ``starts`` ascend, and ranges do not overlap."""
    out = np.empty(len(starts), dtype=np.uint64)
    for at in range(0, len(values), _STEP):
        i, j = np.searchsorted(starts, [at, at + _STEP])
        part = values[at:at + _STEP + _LONG]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(part)))])
        lo = starts[i:j] - at
        out[i:j] = (sums[np.minimum(ends[i:j] - at, len(part))] - sums[lo]) * _powers(_BACK, len(part))[lo]
    out = _mixed(out)
    for k in np.flatnonzero(ends - starts > _LONG):
        out[k] = xxhash.xxh3_64_intdigest(values[starts[k]:ends[k]].tobytes())
    return out


def window_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` consecutive values (unsigned 64-bit)."""
    n = len(values) - size + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * _powers(_BASE, len(values)))])
    return _mixed((sums[size:] - sums[:-size]) * _powers(_BACK, n))
