"""Words, word hashes and shingle sets of texts, vectorised per text.

A word is a maximal run of Unicode letters and digits, lower-cased. Every function takes one text (or its words) and
works on the whole of it; null counts as the empty text.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd multipliers of the shingle hash and of its finaliser (splitmix64's, from the published algorithm).
_POSITION = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class _Separators(dict):
    """Translation of everything that is neither letter nor digit to a space; filled as characters are met."""

    def __missing__(self, code: int) -> int:
        value = self[code] = code if chr(code).isalnum() else 32
        return value


class _WordHashes(dict):
    """64-bit hash of a word, remembered. The memory is bounded: at LIMIT entries it starts afresh."""

    LIMIT = 400_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


_SEPARATORS, _HASHES = _Separators(), _WordHashes()


def words(text: str | None) -> list[str]:
    return text.lower().translate(_SEPARATORS).split() if text else []


def word_hashes(ws: list[str]) -> np.ndarray:
    return np.array(list(map(_HASHES.__getitem__, ws)), dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 over an array of uint64."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` (5 at most) consecutive words, in order; none if the text is shorter."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    x = hashes[:n] * _POSITION[0]
    for k in range(1, size):
        x = x + hashes[k : n + k] * _POSITION[k]
    return mix(x)


def shingle_set(text: str | None, size: int = 3) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    return np.unique(shingle_hashes(word_hashes(words(text)), size))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Likeness of two sorted sets of distinct hashes; 0 if either is empty."""
    if not len(a) or not len(b):
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return both / (len(a) + len(b) - both)


def set_key(sorted_set: np.ndarray) -> int:
    """Signed 64-bit key of a set, equal for texts with the same shingles."""
    return xxhash.xxh3_64_intdigest(sorted_set.tobytes()) - (1 << 63)
