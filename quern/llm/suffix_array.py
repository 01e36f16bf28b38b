"""Two-stage suffix sorting and adjacent common prefixes, in numpy.

Stage one sorts directly only the suffixes that are smaller than their
successors; stage two induces all others by scanning the buckets (first bytes)
in order: a suffix greater than its successor takes the next free place of its
bucket when its successor is passed.  Both order by the first ``depth`` bytes;
suffixes that agree that far stay in any order, which is all that a search for
repeats of ``depth`` bytes needs.
"""

from __future__ import annotations

import numpy as np


def words8(text: np.ndarray) -> np.ndarray:
    """Big-endian 64-bit word at every position, zeros beyond the end."""
    w = np.concatenate([text, np.zeros(8, dtype=np.uint8)]).astype(np.uint64)
    for step in (1, 2, 4):
        w = (w[:-step] << np.uint64(8 * step)) | w[step:]
    return w[: len(text)]


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor; the last counts as smaller."""
    n = len(text)
    step = np.sign(np.diff(text.astype(np.int16)))
    at = np.where(step != 0, np.arange(n - 1), n - 1)
    nearest = np.minimum.accumulate(at[::-1])[::-1]  # where an equal run ends
    out = np.ones(n, dtype=bool)
    out[:-1] = np.concatenate([step, [1]])[nearest] > 0
    return out


def _sort_directly(at: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Positions ``at`` in the order of their suffixes' first ``depth`` bytes."""
    padded = np.concatenate([words, np.zeros(depth + 8, dtype=np.uint64)])
    at = at[np.argsort(padded[at], kind="stable")]
    if not len(at):
        return at
    # Only suffixes that are tied with a neighbour so far are looked at: their places, suffixes and groups.
    place, own = np.arange(len(at)), at.copy()
    start = np.concatenate([[True], padded[at][1:] != padded[at][:-1]])
    for shift in range(8, depth, 8):
        group = np.cumsum(start)
        tied = ~(start & np.concatenate([start[1:], [True]]))
        place, own, group = place[tied], own[tied], group[tied]
        if not len(place):
            break
        key = padded[own + shift]
        order = np.lexsort((key, group))
        own, key = own[order], key[order]
        at[place] = own
        start = np.concatenate([[True], (group[1:] != group[:-1]) | (key[1:] != key[:-1])])
    return at


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``text`` (uint8) in the order of their suffixes' first ``depth`` bytes; zeros follow the end."""
    text = np.append(text, np.uint8(0))
    n = len(text)
    small = smaller_than_next(text)
    sorted_small = _sort_directly(np.nonzero(small)[0], words8(text), depth)
    total = np.bincount(text, minlength=256)
    large = np.bincount(text[~small], minlength=256)
    first = np.concatenate([[0], np.cumsum(total)])
    out = np.empty(n, dtype=np.int64)
    # In a bucket the suffixes greater than their successors come first.
    heads = first[:-1].copy()
    edge = np.concatenate([[0], np.cumsum(np.bincount(text[sorted_small], minlength=256))])
    for c in range(256):
        out[first[c] + large[c] : first[c + 1]] = sorted_small[edge[c] : edge[c + 1]]

    def induce(passed: np.ndarray) -> None:
        j = passed[passed > 0] - 1
        j = j[~small[j]]
        if len(j):
            c = text[j]
            order = np.argsort(c, kind="stable")
            counts = np.bincount(c, minlength=256)
            at = 0
            for b in np.nonzero(counts)[0]:
                m = counts[b]
                out[heads[b] : heads[b] + m] = j[order[at : at + m]]
                heads[b] += m
                at += m

    for c in np.nonzero(total)[0]:
        low = first[c]
        while low < heads[c]:  # a run of one byte induces into its own bucket
            high = heads[c]
            induce(out[low:high])
            low = high
        induce(out[first[c] + large[c] : first[c + 1]])
    return out[out < n - 1]


def common_prefixes(order: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix of each entry of ``order`` with the one before, counted up to ``depth``; the first has 0."""
    padded = np.concatenate([words, np.zeros(depth + 8, dtype=np.uint64)])
    out = np.zeros(len(order), dtype=np.int64)
    open_ = np.arange(1, len(order))
    for shift in range(0, depth, 8):
        if not len(open_):
            break
        x = padded[order[open_] + shift] ^ padded[order[open_ - 1] + shift]
        same = np.zeros(len(open_), dtype=np.int64)
        for k in range(1, 9):
            same += (x >> np.uint64(64 - 8 * k)) == 0
        out[open_] += same
        open_ = open_[same == 8]
    return np.minimum(out, depth)
