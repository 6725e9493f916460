"""Suffix sorting by the difference cover {1, 2} mod 3, for strings that one task holds."""

from __future__ import annotations

import numpy as np

#: Three names are packed in a key, so a string can be this long.
LONGEST = 1 << 21


def _names(key: np.ndarray) -> tuple[np.ndarray, int]:
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[False], key[order[1:]] != key[order[:-1]]])
    names = np.empty(len(key), np.int64)
    names[order] = np.cumsum(new) + 1
    return names, int(new.sum()) + 1


def suffix_order(s: np.ndarray, depth: int) -> np.ndarray:
    """The starts of the suffixes of s (values from 1) in the order of their first `depth` values at least.

    Triples at places not divisible by 3 are sorted and named; where names repeat and don't yet reach the depth, the string
    of names is sorted the same way. The suffixes at places divisible by 3 are sorted by their first value and the rank
    behind it, and merged with the others by what both kinds have a rank for.
    """
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    if n >= LONGEST:
        raise ValueError(f"{n} values are too many for one sort")
    t = np.concatenate([s.astype(np.int64), np.zeros(4, np.int64)])
    ones = np.arange(1, n + (n % 3 == 1), 3)  # one more, past the end, where a suffix at 0 mod 3 is the last
    twos = np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    names, distinct = _names((t[sample] << 42) | (t[sample + 1] << 21) | t[sample + 2])
    if distinct < len(sample) and depth > 3:
        order = suffix_order(names, -(-depth // 3) + 1)
        rank_of = np.empty(len(sample), np.int64)
        rank_of[order] = np.arange(1, len(sample) + 1)
    else:
        order = np.argsort(names, kind="stable")
        rank_of = names
    rank = np.zeros(n + 4, np.int64)
    rank[sample] = rank_of
    by_rank = sample[order]
    by_rank = by_rank[by_rank < n]
    zeros = np.arange(0, n, 3)
    zero_key = (t[zeros] << 32) | rank[zeros + 1]
    zeros = zeros[np.argsort(zero_key, kind="stable")]
    first, second = by_rank[by_rank % 3 == 1], by_rank[by_rank % 3 == 2]
    before = np.searchsorted((t[first] << 32) | rank[first + 1], (t[zeros] << 32) | rank[zeros + 1])
    wide = lambda i: (t[i] << 42) | (t[i + 1] << 21) | rank[i + 2]
    before = before + np.searchsorted(wide(second), wide(zeros))
    out = np.empty(n, np.int64)
    at = np.maximum.accumulate(before) + np.arange(len(zeros)) if len(zeros) else zeros  # ranks can tie beyond the depth
    out[at] = zeros
    free = np.ones(n, bool)
    free[at] = False
    out[free] = by_rank
    return out
