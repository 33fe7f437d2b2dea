"""SetSketch: mergeable registers of exponentially spaced truncated minima (Ertl, VLDB 2021), vectorised in numpy.

A register holds floor(1 - log_b(E / a)), truncated to 0 .. q + 1, where E is the least of n exponential values. Equal
sets have equal registers, the register of a union is the larger of the two, and two registers agree with a probability
close to the Jaccard similarity, so groups of registers can be banded. The joint likelihood of the three counts
(greater, equal, less) and the known sizes gives an estimate of the similarity.
"""

from __future__ import annotations

import numpy as np

from docforge.llm.words import mix

#: Base and rate of the register scale, and the largest step; registers of a sketch unless asked otherwise, and at most.
BASE, RATE, STEPS = 1.02, 20.0, 16_000
REGISTERS, MOST = 448, 2048

#: An odd factor a register. The items are hashes already, so their high halves are mixed enough for 32-bit products.
_A = (mix(np.arange(1, MOST + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_LN_BASE = np.log(BASE)
_BLOCK = 1024


def registers(items: np.ndarray, number: int = REGISTERS) -> np.ndarray:
    """int16 registers of a set of 64-bit hashes; all 0 for the empty set."""
    if not len(items):
        return np.zeros(number, dtype=np.int16)
    short, low = (items >> np.uint64(32)).astype(np.uint32), None
    for k in range(0, len(short), _BLOCK):
        x = (short[k : k + _BLOCK, None] * _A[None, :number]).min(axis=0)
        low = x if low is None else np.minimum(low, x)
    e = -np.log1p(-(low.astype(np.float64) + 0.5) * 2.0**-32)
    return np.clip(np.floor(1.0 - np.log(e / RATE) / _LN_BASE), 0, STEPS + 1).astype(np.int16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(a, b)


def bands(regs: np.ndarray, rows: int, number: int) -> np.ndarray:
    """One signed 64-bit value a band, of registers shaped (texts, rows * number); the band's number is part of the value."""
    x = np.zeros((len(regs), number), dtype=np.uint64) + np.arange(1, number + 1, dtype=np.uint64)[None, :]
    parts = regs.reshape(len(regs), number, rows).astype(np.uint64)
    for k in range(rows):
        x = mix(x * np.uint64(0xC2B2AE3D27D4EB4F) + parts[:, :, k])
    return x.view(np.int64)


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / _LN_BASE


def estimate(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of rows of registers with known set sizes, by golden-section search."""
    more, less = (ra > rb).sum(axis=1), (ra < rb).sum(axis=1)
    same = ra.shape[1] - more - less
    u, v = na / (na + nb), nb / (na + nb)

    def loglik(j: np.ndarray) -> np.ndarray:
        p, q = _p(u - v * j), _p(v - u * j)
        tiny = 1e-300
        return more * np.log(np.maximum(p, tiny)) + less * np.log(np.maximum(q, tiny)) + same * np.log(np.maximum(1 - p - q, tiny))

    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    g = (5**0.5 - 1) / 2
    for _ in range(30):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        left = loglik(a) > loglik(b)
        lo, hi = np.where(left, lo, a), np.where(left, b, hi)
    return (lo + hi) / 2
