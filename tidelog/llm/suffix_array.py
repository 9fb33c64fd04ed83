"""Suffix arrays of integer sequences."""

from __future__ import annotations

import numpy as np


def suffix_array(values: np.ndarray, enough: int | None = None) -> np.ndarray:
    """Positions in the order of their suffixes, by prefix doubling; only places still tied are sorted again.

    A suffix that ends is before those that go on. Suffixes that agree on the first `enough` values may stay in any order.
    """
    n = len(values)
    top = int(values.max()) + 1 if n else 1
    bits = max(1, top.bit_length())
    depth = max(1, min(62 // bits, n))
    key = np.zeros(n, np.int64)
    for k in range(depth):
        key <<= bits
        key[: n - k] |= values[k:] + 1 if k else values + 1
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    new = np.r_[True, np.diff(key[order]) != 0]
    first = np.flatnonzero(new)
    rank[order] = np.repeat(first, np.diff(np.r_[first, n]))
    # runs of ties, as places in the order
    tied = np.flatnonzero(~(new & np.r_[new[1:], True]))
    while len(tied) and (enough is None or depth < enough):
        who = order[tied]
        group = rank[who]
        ahead = np.where(who + depth < n, rank[np.minimum(who + depth, n - 1)] + 1, 0)
        by = np.lexsort((ahead, group))
        who, group, ahead = who[by], group[by], ahead[by]
        order[tied] = who
        new = np.r_[True, (np.diff(group) != 0) | (np.diff(ahead) != 0)]
        first = np.flatnonzero(new)
        rank[who] = np.repeat(tied[first], np.diff(np.r_[first, len(tied)]))
        tied = tied[~(new & np.r_[new[1:], True])]
        depth *= 2
    return order
