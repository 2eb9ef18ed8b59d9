"""Maximal periodic runs in sequences of numbers, in numpy, for code inside tasks.

A run is a stretch of smallest period q that no neighbour extends keeping period q. Every run of two periods or
more ends in one square that no shift to the right keeps, so that the longest common prefix of its two halves'
suffixes is exactly the period. These squares are looked for in the suffix order: an interval of suffixes that
share a prefix of length d is split at each place where only d is shared, and for every suffix i of the smaller
side the inverse suffix array tells whether i + d or i - d lies on the other one. Nothing but arrays stands for
the intervals. Each square is then rotated to the left as far as its period holds, and squares that end up in
the same stretch are one run, of the smallest of their periods.

Many sequences are treated at a time, one after the other, with a number of its own at each one's end and
symbols that no two sequences share.
"""

from __future__ import annotations

import numpy as np

#: Suffixes of smaller sides that are tested at a time.
TESTED_AT_ONCE = 4_000_000


class SuffixOrder:
    """The order of all suffixes by prefix doubling, with what it learns on the way: levels[k] tells equal
    stretches of 2**k symbols, equal numbers for equal ones."""

    def __init__(self, codes: np.ndarray):
        """codes: the symbols, the last of each sequence one that stands nowhere else."""
        n = len(codes)
        self.order = np.argsort(codes, kind="stable").astype(np.int32)
        ordered = codes[self.order]
        new = np.append(True, ordered[1:] != ordered[:-1]) if n else np.empty(0, bool)
        rank = np.empty(n, np.int32)
        rank[self.order] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), 0))
        self.levels = [rank]
        open_slots = np.flatnonzero(~(new & np.append(new[1:], True)))  # suffixes that others still equal
        width = 1
        while len(open_slots):
            at = self.order[open_slots]
            key = rank[at].astype(np.int64) << 32 | rank[at + width]
            by_key = np.argsort(key, kind="stable")
            at, key = at[by_key], key[by_key]
            self.order[open_slots] = at
            new = np.append(True, key[1:] != key[:-1])
            rank = rank.copy()
            rank[at] = open_slots[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
            self.levels.append(rank)
            open_slots = open_slots[~(new & np.append(new[1:], True))]
            width *= 2

    @property
    def place(self) -> np.ndarray:
        """The inverse of the order."""
        return self.levels[-1]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbols that the suffixes at a and b, which differ, have in common."""
        out = np.zeros(len(a), np.int64)
        for k in reversed(range(len(self.levels) - 1)):
            level = self.levels[k]
            out += (level[a + out] == level[b + out]).astype(np.int64) << k
        return out

    def common_before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbols that what lies before a and before b, which differ, has in common."""
        out = np.zeros(len(a), np.int64)
        for k in reversed(range(len(self.levels) - 1)):
            level = self.levels[k]
            x, y = a - out - (1 << k), b - out - (1 << k)
            same = (x >= 0) & (y >= 0)
            same[same] = level[x[same]] == level[y[same]]
            out += same.astype(np.int64) << k
        return out


def _stops(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value the last place before it where one is not larger, and the first behind it where one is
    smaller; values[0] and values[-1] are 0 and stop all."""
    n = len(values)
    places = np.arange(n)
    left, right = np.maximum(places - 1, 0), np.minimum(places + 1, n - 1)
    todo = np.flatnonzero(values > 0)
    while len(todo):  # what is passed over lies above the value, and so does all that it has passed over
        todo = todo[values[left[todo]] > values[todo]]
        left[todo] = left[left[todo]]
    todo = np.flatnonzero(values > 0)
    while len(todo):
        todo = todo[values[right[todo]] >= values[todo]]
        right[todo] = right[right[todo]]
    return left, right


def branching_squares(suffixes: SuffixOrder, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of all squares whose halves' suffixes share just the period, of intervals with `least`
    suffixes or more."""
    order, place, n = suffixes.order, suffixes.place, len(suffixes.order)
    first = suffixes.levels[0]
    shared = np.zeros(n + 1, np.int64)  # symbols that the suffixes at slots k - 1 and k share
    near = np.flatnonzero(first[order[1:]] == first[order[:-1]]) + 1
    shared[near] = suffixes.common(order[near - 1].astype(np.int64), order[near].astype(np.int64))
    left, right = _stops(shared)
    k = near[right[near] - left[near] >= least]
    # slots left .. k - 1 and k .. right - 1 share shared[k] symbols, and no more with each other
    low, high = left[k], right[k]
    by_left = k - low <= high - k
    start, stop = np.where(by_left, low, k), np.where(by_left, k, high)
    other, behind = np.where(by_left, k, low), np.where(by_left, high, k)
    size = stop - start
    found_at, found_period = [], []
    upto = np.cumsum(size)
    begin = 0
    while begin < len(k):
        end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + TESTED_AT_ONCE, "right")))
        part = slice(begin, end)
        many = size[part]
        slot = np.arange(int(many.sum())) + np.repeat(start[part] - np.cumsum(many) + many, many)
        i = order[slot].astype(np.int64)
        d, lo, hi = (np.repeat(x[part], many) for x in (shared[k], other, behind))
        for shift in (d, -d):
            j = i + shift
            there = np.where(j >= 0, place[np.clip(j, 0, n - 1)], -1)
            hit = (there >= lo) & (there < hi)
            found_at.append(np.minimum(i, j)[hit])
            found_period.append(d[hit])
        begin = end
    none = [np.empty(0, np.int64)]
    return np.concatenate(found_at or none), np.concatenate(found_period or none)


def periodic_runs(sequences: list[np.ndarray], least_length: int = 6, least_periods: int = 4) -> tuple[np.ndarray, ...]:
    """sequence, start, length and period of all runs of least_length symbols and least_periods (2 or more)
    periods, by sequence, start and period. Symbols are numbers from 0."""
    sizes = np.array([len(s) for s in sequences], np.int64)
    begins = np.cumsum(np.append(0, sizes + 1))
    if not sizes.sum():
        return tuple(np.empty(0, np.int64) for _ in range(4))
    symbols = 2 + max(int(s.max()) for s in sequences if len(s))
    codes = np.concatenate([np.append(s.astype(np.int64) + 1, 0) + k * symbols for k, s in enumerate(sequences)])
    suffixes = SuffixOrder(codes)
    # at least that many suffixes, a period apart, share one period
    at, period = branching_squares(suffixes, least_periods)
    before = suffixes.common_before(at, at + period)
    start, length = at - before, before + 2 * period
    long = length >= np.maximum(least_length, least_periods * period)
    start, length, period = start[long], length[long], period[long]
    ranked = np.lexsort((period, length, start))
    start, length, period = start[ranked], length[ranked], period[ranked]
    kept = np.append(True, (start[1:] != start[:-1]) | (length[1:] != length[:-1]))[: len(start)]
    start, length, period = start[kept], length[kept], period[kept]
    owner = np.searchsorted(begins, start, "right") - 1
    start = start - begins[owner]
    ranked = np.lexsort((period, start, owner))
    return owner[ranked], start[ranked], length[ranked], period[ranked]
