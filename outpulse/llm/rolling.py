"""Hashes of all stretches of a byte string from one pass over it, modulo 2**64."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_held: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse. They are kept for the next call."""
    if not _held or len(_held[0]) < n:
        size = max(n, 1 << 17)
        pair = []
        for base in (_BASE, _INVERSE):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            pair.append(np.multiply.accumulate(factors))
        _held[:] = pair
    return _held[0][:n], _held[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Hashes whose order does not follow that of their inputs."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Sums of ``(byte + 1) * base**i`` before each place."""
    up, _ = powers(len(data))
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    return sums


def stretches(sums: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Hashes of the stretches from ``starts`` to before ``stops``, the same wherever they stand."""
    _, down = powers(len(sums))
    return mixed((sums[stops] - sums[starts]) * down[starts])


def all_stretches(sums: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all stretches of ``size`` bytes."""
    _, down = powers(len(sums))
    return mixed((sums[size:] - sums[:-size]) * down[: len(sums) - size])
