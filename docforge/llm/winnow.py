"""Winnowing (Schleimer, Wilkerson, Aiken 2003) over words: rolling hashes of K words, the least of each window selected.

Two texts that share a run of at least WINDOW + K - 1 words share a selected hash. A seed is a run of ORDER neighbouring
selected hashes, which is rare where single ones are boiler-plate.
"""

from __future__ import annotations

import numpy as np

from docforge.llm.words import mix, shingle_hashes

K, WINDOW, ORDER = 5, 8, 3


def _windowed_least(s: np.ndarray, window: int) -> np.ndarray:
    n = max(1, len(s) - window + 1)
    least = s[:n].copy()
    for k in range(1, min(window, len(s))):
        np.minimum(least, s[k : n + k], out=least)
    return least


def selected(hashes: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Selected shingle hashes in order, and a word position of each (where the value first stands in its window)."""
    s = shingle_hashes(hashes, K)
    if not len(s):
        return np.empty(0, dtype=np.int64), s
    least = _windowed_least(s, window)
    first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    value = least[first]
    at = first.copy()
    for k in range(min(window, len(s)) - 1, -1, -1):
        inside = np.minimum(first + k, len(s) - 1)
        at = np.where(s[inside] == value, inside, at)
    return at, value


def seeds(hashes: np.ndarray, order: int = ORDER, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Word positions and signed 64-bit values of the seeds of a text, in order. A text too short for one has its whole
    run of words as its only seed; a text without words has none."""
    at, value = selected(hashes, window)
    if len(value) < order:
        if not len(hashes):
            return at[:0], value[:0].view(np.int64)
        whole = np.array([len(hashes)], dtype=np.uint64)
        for h in hashes:
            whole = mix(whole + h)
        return np.zeros(1, dtype=np.int64), whole.view(np.int64)
    n = len(value) - order + 1
    x = value[:n].copy()
    for k in range(1, order):
        x = mix(x * np.uint64(0xC2B2AE3D27D4EB4F) + value[k : n + k])
    return at[:n], x.view(np.int64)
