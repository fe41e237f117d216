"""SetSketch registers: exponentially spaced truncated minima of hashed sets.

Every element has, for every register, an exponentially distributed value of rate ``RATE``; a register holds
``clip(floor(1 - log_b(smallest value)), 0, q + 1)``. Registers of two sets merge by maximum, and two registers are
equal with a probability that grows with the Jaccard similarity, which makes them usable for banding. Both uses
follow O. Ertl, SetSketch: Filling the Gap between MinHash and HyperLogLog (VLDB 2021).
"""

from __future__ import annotations

import numpy as np

REGISTERS = 384
BASE = 1.001
RATE = 20.0
LIMIT = 65_535


def _multipliers(seed: int = 0x5E75) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


MULTIPLIERS = _multipliers()


def sketch(elements: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Registers (uint16, one row per set) of non-empty sets, each a slice of the 64-bit element hashes."""
    values = np.empty((len(offsets) - 1, REGISTERS), np.uint16)
    if not len(values):
        return values
    hashed = elements.astype(np.uint64)
    hashed ^= hashed >> np.uint64(32)
    shift = np.uint64(32)
    for i, multiplier in enumerate(MULTIPLIERS):
        least = np.minimum.reduceat((hashed * multiplier) >> shift, offsets[:-1])
        uniform = (least.astype(np.float64) + 0.5) / 2.0**32
        smallest = -np.log1p(-uniform) / RATE
        values[:, i] = np.clip(np.floor(1.0 - np.log(smallest) / np.log(BASE)), 0, LIMIT)
    return values


def merge(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(first, second)


def jaccard(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, steps: int = 200) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of row pairs, jointly from greater, equal and smaller registers."""
    greater = (a > b).sum(axis=1)[:, None]
    smaller = (a < b).sum(axis=1)[:, None]
    equal = REGISTERS - greater - smaller
    whole = (size_a + size_b).astype(float)
    u, v = (size_a / whole)[:, None], (size_b / whole)[:, None]
    most = np.minimum(u / v, v / u)
    grid = np.linspace(0.0, 1.0, steps + 1)[None, :] * most

    def probability(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    more, less = probability(u - v * grid), probability(v - u * grid)
    tiny = 1e-12
    likelihood = greater * np.log(more + tiny) + smaller * np.log(less + tiny)
    likelihood += equal * np.log(np.maximum(1 - more - less, 0) + tiny)
    return grid[np.arange(len(grid)), likelihood.argmax(axis=1)]


def bands_for(threshold: float, miss: float = 0.003) -> tuple[int, int]:
    """(rows, bands): the most selective banding that misses a pair at the threshold with at most ``miss``."""
    rows = max(r for r in range(1, 33) if r == 1 or (1 - threshold**r) ** (REGISTERS // r) <= miss)
    return rows, REGISTERS // rows


def band_keys(registers: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """A 64-bit key for every band (columns) of every set (rows)."""
    mix = np.random.default_rng(0xBA2D).integers(0, 2**63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    keys = np.zeros((len(registers), bands), np.uint64)
    grouped = registers[:, : rows * bands].reshape(len(registers), bands, rows).astype(np.uint64)
    for i in range(rows):
        keys = (keys ^ (grouped[:, :, i] + np.uint64(i + 1))) * mix[i]
        keys ^= keys >> np.uint64(29)
    return keys
