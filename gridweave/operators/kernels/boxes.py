"""Pairs of boxes (rows x0, y0, x1, y1) by their overlap over their union, without a look at pairs that can't reach the least."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from gridweave.functions.measures import EPS
from gridweave.operators.kernels.arrangement import spans, spread

#: Overlaps over unions that best() looks for, one after the other, while a box has none.
BANDS = (0.9, 0.8, 0.65, 0.5, 0.35, 0.25)


def alike(a: np.ndarray, b: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of a and of b, and their overlap over their union, of all pairs that reach least (above 0), some at a time, by rows of a.

    Of two boxes that do, one begins before the other by 1 - least of its own side at most, and sides differ by the factor
    least at most. b is sorted by bins of y0, and in each by x0, so the boxes that can be meant are stretches of it.
    """
    if not len(a) or not len(b):
        return
    sides, most = a[:, 2:] - a[:, :2], (b[:, 2:] - b[:, :2]).max(0)
    back = np.minimum(sides * (1 - least) / least, most * (1 - least))
    low, high = a[:, :2] - back - 1e-6, a[:, :2] + sides * (1 - least) + 1e-6
    base = np.minimum(low.min(0), b[:, :2].min(0))
    height = max(float(np.median(high[:, 1] - low[:, 1])) / 3, float(b[:, 1].max() - base[1]) / (1 << 16), 1e-6)
    wide = max(float(high[:, 0].max()), float(b[:, 0].max())) - base[0] + 1  # of a bin
    bin_of = lambda y: np.floor((y - base[1]) / height)
    key = bin_of(b[:, 1]) * wide + (b[:, 0] - base[0])
    order = np.argsort(key)
    key, b = key[order], b[order]
    slack = 1e-9 * max(1.0, float(key[-1]))
    first = bin_of(low[:, 1])
    which, nth = spread((np.minimum(bin_of(high[:, 1]), bin_of(b[:, 1].max())) - first + 1).clip(0).astype(np.int64))
    row = (first[which] + nth) * wide - base[0]
    start = np.searchsorted(key, row + low[which, 0] - slack)
    counts = np.maximum(np.searchsorted(key, row + high[which, 0] + slack, "right") - start, 0)
    sizes = [(c[:, 2] - c[:, 0]) * (c[:, 3] - c[:, 1]) for c in (a, b)]
    for at, to in spans(counts):
        j, k = spread(counts[at:to])
        i, j = which[at:to][j], start[at:to][j] + k
        both = np.maximum(np.minimum(a[i, 2], b[j, 2]) - np.maximum(a[i, 0], b[j, 0]), 0.0)
        both *= np.maximum(np.minimum(a[i, 3], b[j, 3]) - np.maximum(a[i, 1], b[j, 1]), 0.0)
        share = both / (sizes[0][i] + sizes[1][j] - both + EPS)
        good = share >= least
        yield i[good], order[j[good]], share[good]


def best(a: np.ndarray, b: np.ndarray, ids: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a that some row of b reaches least with, the best one's id, the least on a tie, and their overlap over their union.

    A box that has found one in a band needs no look at lower ones.
    """
    top, who = np.zeros(len(a)), np.zeros(len(a), np.int64)
    open_ = np.arange(len(a))
    for band in [*(x for x in BANDS if x > least), least]:
        for i, j, share in alike(a[open_], b, band):
            i, was = open_[i], top[open_]
            np.maximum.at(top, i, share)
            who[open_[top[open_] > was]] = np.iinfo(np.int64).max
            same = share == top[i]
            np.minimum.at(who, i[same], ids[j[same]])
        open_ = open_[top[open_] == 0]
        if not len(open_):
            break
    found = np.flatnonzero(top > 0)
    return found, who[found], top[found]
