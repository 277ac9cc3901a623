"""Suffix array of a byte string by the difference-cover method (modulo 3), on arrays.

The suffixes at places 1 and 2 modulo 3 are the sample: their leading triples are sorted and named, and the string
of names is sorted by recursion while names repeat. The rest is sorted by its first symbol and the rank of the
sampled suffix behind it, then merged: against places of 1 by (symbol, rank), of 2 by (two symbols, rank).
"""

from __future__ import annotations

import numpy as np


def _pack(*columns: np.ndarray) -> np.ndarray:
    """One integer key that sorts as the tuple of columns; columns too wide for it are named first."""
    key, width = columns[0].astype(np.int64), int(columns[0].max(initial=0)) + 1
    for c in columns[1:]:
        top = int(c.max(initial=0)) + 1
        if width * top >= 2**62:
            _, key = np.unique(key, return_inverse=True)
            width = int(key.max(initial=0)) + 1
        key, width = key * top + c, width * top
    return key


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Places of all suffixes of s (non-negative integers) in order; the end sorts before any symbol."""
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.zeros(n + 3, np.int64)
    t[:n] = s
    t[:n] += 1
    ones = np.arange(1, n + (n % 3 == 1), 3)  # a dummy place n keeps the halves apart if n is 1 modulo 3
    twos = np.arange(2, n, 3)
    sample = np.r_[ones, twos]
    order = np.argsort(key := _pack(t[sample], t[sample + 1], t[np.minimum(sample + 2, n + 2)]), kind="stable")
    names = np.zeros(len(sample), np.int64)
    fresh = np.r_[False, key[order[1:]] != key[order[:-1]]]
    names[order] = np.cumsum(fresh)
    if names.max(initial=0) + 1 < len(sample):
        order = suffix_array(names)
    rank = np.zeros(n + 3, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    zeros = np.arange(0, n, 3)
    zeros = zeros[np.argsort(_pack(t[zeros], rank[zeros + 1]), kind="stable")]
    placed = sample[order]
    placed = placed[placed < n]
    one, two = placed[placed % 3 == 1], placed[placed % 3 == 2]
    both = _pack(np.r_[t[zeros], t[one]], np.r_[rank[zeros + 1], rank[one + 1]])
    below = np.searchsorted(both[len(zeros) :], both[: len(zeros)])
    both = _pack(np.r_[t[zeros], t[two]], np.r_[t[zeros + 1], t[two + 1]], np.r_[rank[zeros + 2], rank[two + 2]])
    below = below + np.searchsorted(both[len(zeros) :], both[: len(zeros)])
    out = np.empty(n, np.int64)
    at = np.arange(len(zeros)) + below
    out[at] = zeros
    rest = np.ones(n, bool)
    rest[at] = False
    out[rest] = placed
    return out
