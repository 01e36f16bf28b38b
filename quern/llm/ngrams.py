"""Hashed word n-gram features, computed a batch at a time over raw bytes.

A word's hash is a polynomial over its bytes, read off two prefix sums; an
n-gram's hash combines its words' hashes.  Three views of a text share one
space of 2**bits buckets: words and word pairs; runs of three word *shapes*
(letter case, digits, marks, equal to the word before); and runs of three flags
that say whether a word pair occurred before in the text.
"""

from __future__ import annotations

import numpy as np

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 9, 10, 11, 12, 13]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_rng = np.random.default_rng(7)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
# Shape class of a byte: 1 lower, 2 upper, 4 digit, 8 table or symbol mark, 16 other mark, 32 letters beyond ASCII.
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 4, 32
_CLASS[[ord(c) for c in "#*$%&|<>@^~=_+/\\{}[]"]] = 8
_CLASS[[ord(c) for c in "!?;:\"'()-"]] = 16

with np.errstate(over="ignore"):
    _INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, kept between calls."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, b in enumerate((_BASE, _INVERSE)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word of a byte array."""
    edge = np.diff(np.concatenate([[False], ~_BLANK[data], [False]]).astype(np.int8))
    return np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]


def features(text: bytes, bits: int, shapes: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a whole text and their weights, scaled to length one."""
    data = np.frombuffer(text, dtype=np.uint8)
    start, end = words(data)
    if not len(start):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float32)
    with np.errstate(over="ignore"):
        up, down = _power(len(data) + 1)
        total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_BYTE[data] * up[:-1], dtype=np.uint64)])
        word = mix((total[end] - total[start]) * down[start])
        pair = mix(word[:-1] + word[1:] * _BASE)
        parts = [word, pair + np.uint64(1)]
        if shapes:
            kind = np.bitwise_or.reduceat(_CLASS[data], np.stack([start, end], axis=1).ravel()[: 2 * len(start) - 1])[::2]
            same = np.concatenate([[False], word[1:] == word[:-1]])
            shape = kind.astype(np.uint64) * np.uint64(2) + same.astype(np.uint64)
            seen = np.ones(len(pair), dtype=np.uint64)
            seen[np.unique(pair, return_index=True)[1]] = 0
            for salt, s in ((2, shape), (3, seen)):
                if len(s) >= 3:
                    code = (s[:-2] * np.uint64(256) + s[1:-1]) * np.uint64(256) + s[2:]
                    parts.append(mix(code * np.uint64(4) + np.uint64(salt)))
    buckets, weights = [], []
    for p in parts:
        if len(p):
            b, n = np.unique((p >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
            w = np.sqrt(n.astype(np.float64))  # damped counts; each view gets the same length
            buckets.append(b)
            weights.append(w / np.sqrt((w * w).sum()))
    b = np.concatenate(buckets)
    w = np.concatenate(weights) / np.sqrt(len(buckets))
    return b, w.astype(np.float32)
