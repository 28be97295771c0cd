"""Suffix arrays, Burrows-Wheeler transforms and bounded common prefixes of integer strings, in numpy."""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` symbols at least (prefix doubling; past the end counts as least)."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64) + 1
    order, reach = np.argsort(rank), 1
    while reach < depth and n:
        after = np.zeros(n, dtype=np.int64)
        after[: n - reach] = rank[reach:]
        key = rank * (n + 2) + after
        order = np.argsort(key)
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
        reach *= 2
        if rank[order[-1]] == n:
            break
    return order


def prefixes_of(symbols: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """For each row of the suffix array, the common prefix with the row before, up to ``least``.

    The last symbol must be a sentinel, less than all others.

    Breadth-first: an interval of rows that start with a string is extended to the left by each symbol that the
    transform holds in it. The right end of a new interval of strings of length l + 1 gets the value l
    if it has none yet, and only then is the interval extended again, so values are found in
    increasing order. The expansion stops at ``least``: what has no value then shares that many symbols or more.
    """
    n = len(order)
    found = np.full(n + 1, least, dtype=np.int32)
    if not n:
        return found[:0]
    known = np.zeros(n + 1, dtype=bool)
    found[[0, n]], known[[0, n]] = 0, True
    # a row's predecessor: its symbol, and where the longer suffix stands
    before = np.where(order > 0, symbols[order - 1], -1)
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    previous = np.where(order > 0, place[order - 1], -1)
    lo, hi = np.array([0]), np.array([n])
    # the empty string's interval yields those of single symbols
    for length in range(least):
        size = hi - lo
        rows = np.arange(size.sum()) + np.repeat(lo - (np.cumsum(size) - size), size)
        owner = np.repeat(np.arange(len(lo)), size)
        has = before[rows] >= 0
        rows, owner = rows[has], owner[has]
        if not len(rows):
            break
        # rows of one interval with one symbol lead to neighbouring rows: sorted by them, a new group starts at each gap
        to = previous[rows]
        by = np.argsort(to)
        to, owner, symbol = to[by], owner[by], before[rows][by]
        new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (symbol[1:] != symbol[:-1])]))
        start, end = to[new], np.concatenate([to[new[1:] - 1], to[-1:]]) + 1
        if not length:  # the sentinel comes before the first symbol, which has no row of its own above
            start, end = np.append(start, 0), np.append(end, 1)
        fresh = ~known[end]
        # the interval's end is the first row of another string: the prefix before it is shorter than length + 1
        known[end[fresh]] = True
        found[end[fresh]] = length
        lo, hi = start[fresh], end[fresh]
        if not len(lo):
            break
    return found[:n]
