"""64-bit hashes in numpy."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_tables = [np.ones(1, U64), np.ones(1, U64)]


def mixed(x: np.ndarray) -> np.ndarray:
    """Well-mixed hashes of 64-bit numbers."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of an odd number modulo 2 ** 64, and of its inverse."""
    if len(_tables[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            _tables[i] = np.cumprod(np.concatenate([np.ones(1, U64), np.full(n + n // 4, base, U64)]), dtype=U64)
    return _tables[0][:n], _tables[1][:n]


def prefix_hashes(symbols: np.ndarray) -> np.ndarray:
    """Sums from which ``span_hashes`` takes the hash of any run of symbols."""
    sums = np.zeros(len(symbols) + 1, U64)
    np.cumsum((symbols + U64(1)) * powers(len(symbols))[0], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the runs [start, end); equal runs have equal hashes wherever they stand."""
    return mixed((sums[end] - sums[start]) * powers(len(sums))[1][start])
