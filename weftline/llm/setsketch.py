"""SetSketch: mergeable, locality-sensitive registers of sets and their joint likelihood.

A register is the truncated, exponentially spaced minimum of one hash over a set: the
smallest hash of the set, as an exponential variate x, becomes 1 - log_b(x), rounded down
and clamped to [0, LEVELS]. A union has the larger register of its parts.
"""

from __future__ import annotations

import math

import numpy as np

from weftline.llm.words import mix64

BASE = 1.001
LEVELS = (1 << 16) - 2
#: rate of the exponential variates: sets of 1 to 10^12 elements stay inside the levels
RATE = 20.0


def _multipliers(registers: int) -> tuple[np.ndarray, np.ndarray]:
    n = np.arange(1, 2 * registers + 1, dtype=np.uint64)
    x = (mix64(n * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
    return x[:registers], x[registers:] | np.uint32(1)


def registers_of(elements: np.ndarray, registers: int, tables: tuple | None = None) -> np.ndarray:
    """Registers of a set of 64-bit hashes as uint16; an empty set has zeros."""
    if not len(elements):
        return np.zeros(registers, np.uint16)
    flip, factor = tables or _multipliers(registers)
    low = np.full(registers, np.iinfo(np.uint32).max, np.uint32)
    high = (elements >> np.uint64(32)).astype(np.uint32)
    rest = elements.astype(np.uint32)
    for at in range(0, len(elements), 256):
        x = high[at : at + 256, None] ^ flip
        x *= factor
        x ^= x >> np.uint32(16)
        x += rest[at : at + 256, None]
        x *= factor[::-1]
        np.minimum(low, x.min(axis=0), out=low)
    share = (low.astype(np.float64) + 0.5) / 2.0**32
    level = np.floor(1 - np.log(-np.log1p(-share) / RATE) / math.log(BASE))
    # the levels of tiny sets lie below 0 in this base: shift them into the range
    return np.clip(level + SHIFT, 0, LEVELS).astype(np.uint16)


SHIFT = 4000


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(a, b)


def jaccard_estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarities of pairs (rows) from their joint registers.

    With u, v the shares of the two sizes, a register is larger in the first set with
    probability p(u - vJ), larger in the second with p(v - uJ), where
    p(x) = -log_b(1 - x (b - 1) / b); the likelihood is concave in J.
    """
    size_a, size_b = size_a.astype(float), size_b.astype(float)
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    total = np.maximum(size_a + size_b, 1)
    u, v = size_a / total, size_b / total
    low = np.zeros(len(a))
    high = np.minimum(u, v) / np.maximum(np.maximum(u, v), 1e-300)

    def p(x):
        return np.clip(-np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / math.log(BASE), 1e-12, 1 - 1e-12)

    def likelihood(j):
        up, down = p(u - v * j), p(v - u * j)
        return more * np.log(up) + less * np.log(down) + same * np.log(np.maximum(1 - up - down, 1e-12))

    for _ in range(40):
        third = (high - low) / 3
        x, y = low + third, high - third
        rising = likelihood(x) < likelihood(y)
        low, high = np.where(rising, x, low), np.where(rising, high, y)
    return (low + high) / 2
