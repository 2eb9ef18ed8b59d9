"""ProbMinHash signatures of weighted sets, for code that runs inside tasks.

Each element of weight w sends out arrivals of a Poisson process of rate w, each to a random one of
m registers; a register keeps the element that arrives first. Two sets agree in a register with
their probability Jaccard similarity. An element stops as soon as its next arrival is later than
the latest first arrival over all registers. Many documents are done at once.
"""

from __future__ import annotations

import numpy as np

from barloom.llm.shingles import MIX, mixed


def signatures(docs: int, owner: np.ndarray, elements: np.ndarray, weights: np.ndarray, m: int) -> np.ndarray:
    """(docs, m) elements kept by the registers. owner: the document of each element; every
    document has an element, no element twice."""
    first = np.full(docs * m, np.inf)
    kept = np.zeros(docs * m, np.uint64)
    at, owner, rate, element = np.zeros(len(elements)), owner.astype(np.int64), weights.astype(np.float64), elements
    state = mixed(element ^ np.uint64(MIX[1]))
    while len(owner):
        state = mixed(state)
        u = ((state >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
        at = at - np.log(u) / rate
        alive = at < first.reshape(docs, m).max(axis=1)[owner]
        at, owner, rate, element, state = at[alive], owner[alive], rate[alive], element[alive], state[alive]
        slot = owner * m + (mixed(state ^ np.uint64(MIX[2])) % np.uint64(m)).astype(np.int64)
        np.minimum.at(first, slot, at)
        won = first[slot] == at
        kept[slot[won]] = element[won]
    return kept.reshape(docs, m)


def bands(kept: np.ndarray, rows: int) -> np.ndarray:
    """One hash for each run of `rows` registers."""
    out = np.zeros((kept.shape[0], kept.shape[1] // rows), np.uint64)
    parts = kept.reshape(kept.shape[0], -1, rows)
    for k in range(rows):
        out = mixed(out ^ parts[:, :, k])
    return out.view(np.int64)


def two_bits(kept: np.ndarray) -> np.ndarray:
    """The two lowest bits of each register as four words: low and high bits of the first half of the
    registers, then of the second half (at most 63 registers each)."""
    half = kept.shape[1] // 2
    place = np.uint64(1) << np.arange(half, dtype=np.uint64)
    words = [((kept[:, k * half : (k + 1) * half] >> np.uint64(b)) & np.uint64(1)) @ place for k in range(2) for b in range(2)]
    return np.stack(words, axis=1).view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Exact probability Jaccard of two multisets of elements: the sum over common elements d of
    1 / sum over all e of max(x_e / x_d, y_e / y_d)."""
    ea, x = np.unique(a, return_counts=True)
    eb, y = np.unique(b, return_counts=True)
    both, ia, ib = np.intersect1d(ea, eb, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    if len(ea) == len(a) and len(eb) == len(b):
        return len(both) / (len(ea) + len(eb) - len(both))
    xs, ys = x[ia].astype(np.float64), y[ib].astype(np.float64)
    only_x, only_y = x.sum() - xs.sum(), y.sum() - ys.sum()
    order = np.argsort(xs / ys)
    xs, ys = xs[order], ys[order]
    ratio = xs / ys
    # elements of larger ratio count by x, those of smaller or equal ratio by y
    x_above, y_upto = np.concatenate([np.cumsum(xs[::-1])[::-1], [0.0]]), np.concatenate([[0.0], np.cumsum(ys)])
    cut = np.searchsorted(ratio, ratio, side="right")
    return float((1.0 / ((x_above[cut] + only_x) / xs + (y_upto[cut] + only_y) / ys)).sum())
