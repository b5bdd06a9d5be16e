"""Long repeats in a block of texts, by threshold-bounded interval expansion on a Burrows-Wheeler transform."""

from __future__ import annotations

import numpy as np


def suffix_order(data: np.ndarray, depth: int) -> np.ndarray:
    """Positions of data in the order of their suffixes' first `depth` bytes at least, by doubling from 8 bytes on."""
    n = len(data)
    wide = np.concatenate([data, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = key << np.uint64(8) | wide[i : i + n].astype(np.uint64)
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(np.concatenate([[False], key[order][1:] != key[order][:-1]])) + 1
    h = 8
    while h < depth and rank.max(initial=0) < n:
        behind = np.zeros(n, np.int64)
        behind[: max(0, n - h)] = rank[h:]
        pair = rank * (n + 1) + behind
        order = np.argsort(pair, kind="stable")
        rank[order] = np.cumsum(np.concatenate([[False], pair[order][1:] != pair[order][:-1]])) + 1
        h *= 2
    return order


def repeat_groups(data: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): suffixes in sorted order, and for each the number of its group of equal first `least` bytes.

    Common prefixes with the suffix before are found by increasing length: the interval of a string w whose right
    border was new at length l is extended by each byte c before it, and the border of cw, if it is still open, gets
    l + 1. Borders that are open when `least` is reached have a common prefix at least that long. The last byte of data
    must be nowhere else in it.
    """
    n = len(data)
    order = suffix_order(data, least)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    back = place[order - 1]  # the step to the suffix that begins a byte earlier; the text's first byte has none
    has = order > 0
    first = data[order]
    closed = np.zeros(n + 1, bool)
    closed[0] = closed[n] = True
    low, high = np.array([0]), np.array([n - 1])
    owner = np.empty(n, np.int64)
    for _ in range(least):
        sizes = high - low + 1
        total = int(sizes.sum())
        if not total:
            break
        which = np.repeat(np.arange(len(low)), sizes)
        at = np.arange(total) + np.repeat(low - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
        which, at = which[has[at]], at[has[at]]
        to = back[at]
        owner[to] = which
        to.sort()
        new = np.concatenate([[True], (to[1:] != to[:-1] + 1) | (owner[to[1:]] != owner[to[:-1]]) | (first[to[1:]] != first[to[:-1]])]) if len(to) else np.zeros(0, bool)
        low = to[new]
        high = to[np.concatenate([new[1:], [True]])] if len(to) else to
        open_ = ~closed[high + 1]
        low, high = low[open_], high[open_]
        closed[high + 1] = True
    return order, np.cumsum(closed[:n]) - 1


def later_windows(data: np.ndarray, valid: np.ndarray, least: int) -> np.ndarray:
    """For each position of data: whether it is valid and its next `least` bytes also begin at an earlier valid position."""
    order, group = repeat_groups(data, least)
    ok = valid[order]
    at, group = order[ok], group[ok]
    out = np.zeros(len(data), bool)
    if len(at):
        begin = np.concatenate([[True], group[1:] != group[:-1]])
        earliest = np.minimum.reduceat(at, np.flatnonzero(begin))
        out[at] = at > earliest[np.cumsum(begin) - 1]
    return out
