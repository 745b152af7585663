"""Hashed word shingles of whole texts, in numpy over the bytes of a text.

Words are the runs of bytes other than 0x20 and 0x09-0x0D, after A-Z became a-z.
A word's hash is a polynomial over random 64-bit values of its bytes, modulo 2^64
(the multiplier is odd, so a prefix sum can be divided back); a shingle's hash is
a polynomial over the mixed hashes of its words.  The hash has 64 bits: two
different shingles of one corpus of n meet with probability about n^2 / 2^65.
"""

from __future__ import annotations

import numpy as np

WORDS = 5

_U = np.uint64
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32
_VALUE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_Q = 0xD1B54A32D192ED03

_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        have = np.full(size, _U(base))
        have[0] = _U(1)
        have = np.multiply.accumulate(have)
        if size <= 1 << 22:
            _POWERS[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads every bit over all 64."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def word_hashes(data: bytes) -> np.ndarray:
    """A hash of each word, in order."""
    raw = _FOLD[np.frombuffer(data, np.uint8)]
    inside = np.empty(len(raw) + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(_BLANK[raw], out=inside[1:-1])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64)
    total = np.empty(len(raw) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_VALUE[raw] * _powers(_P, len(raw)), out=total[1:])
    return mix((total[end] - total[start]) * _powers(_P_INV, len(raw))[start] + (end - start).astype(np.uint64))


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles of ``words`` words; with fewer words the whole sequence as one."""
    h = word_hashes((text or "").encode("utf-8", "surrogatepass"))
    if not len(h):
        return h
    n = min(words, len(h))
    size = len(h) - n + 1
    out = np.zeros(size, np.uint64)
    for k in range(n):
        out = out * _U(_Q) + h[k:k + size]
    return np.unique(mix(out + _U(n)))
