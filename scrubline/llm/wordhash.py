"""Words and shingles of a text as 64-bit hashes, computed for all words at once.

The hash of a byte range is a polynomial modulo 2**64 over a table of random odd numbers, taken
from prefix sums, so every range costs the same, then mixed; it depends on nothing but the bytes.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20_240_229)
BYTE_VALUE = _RNG.integers(1, 1 << 63, 257, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15 | 1
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_POWERS = np.ones(1, np.uint64)
_INVERSE = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n at least."""
    global _POWERS, _INVERSE
    if len(_POWERS) < n:
        size = 1 << max(16, (n - 1).bit_length())
        up, down = np.full(size, BASE, np.uint64), np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS, _INVERSE = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS, _INVERSE


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    """C with hash(i, j) = (C[j] - C[i]) * BASE**-i before mixing; codes index BYTE_VALUE."""
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[codes] * powers(len(codes))[0][: len(codes)], out=out[1:])
    return out


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_bytes(text: str) -> np.ndarray:
    """The UTF-8 bytes of a text with A-Z lower-cased."""
    return _LOWER[np.frombuffer(text.encode("utf-8"), np.uint8)]


def word_bounds(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ of a byte array."""
    inside = np.concatenate([[False], ~_SPACE[b], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


def word_hashes(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word."""
    start, end = word_bounds(b)
    if not len(start):
        return np.empty(0, np.uint64), start, end
    sums = prefix_sums(b)
    return mix((sums[end] - sums[start]) * powers(len(b) + 1)[1][start] + (end - start).astype(np.uint64)), start, end


def shingles(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles of so many words.

    With fewer words the whole sequence is the one shingle; without words there is none.
    """
    if not text:
        return np.empty(0, np.uint64)
    w, _, _ = word_hashes(lower_bytes(text))
    if not len(w):
        return w
    k = min(width, len(w))
    h = w[: len(w) - k + 1].copy()
    for i in range(1, k):
        h = mix(h * np.uint64(BASE) + w[i : len(w) - k + 1 + i])
    return np.unique(mix(h + np.uint64(k)))
