"""Area and volume of the union of boxes (Klee's measure), by vectorized slabs."""

from __future__ import annotations

import numpy as np


def union_length(low: np.ndarray, high: np.ndarray) -> float:
    order = np.argsort(low, kind="stable")
    low, high = low[order], high[order]
    reach = np.maximum.accumulate(high)
    before = np.r_[-np.inf, reach[:-1]]
    return float(np.maximum(0.0, reach - np.maximum(low, before)).sum())


def union_measure(low: np.ndarray, high: np.ndarray) -> float:
    """low, high: boxes x axes, double. Boxes with an empty side count nothing; no boxes measure 0."""
    low, high = np.asarray(low, np.float64), np.asarray(high, np.float64)
    if low.size == 0:
        return 0.0
    full = (high > low).all(axis=1)
    low, high = low[full], high[full]
    if not len(low):
        return 0.0
    if low.shape[1] == 1:
        return union_length(low[:, 0], high[:, 0])
    cuts = np.unique(np.r_[low[:, 0], high[:, 0]])
    total = 0.0
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        on = (low[:, 0] <= a) & (high[:, 0] >= b)
        if on.any():
            total += (b - a) * union_measure(low[on, 1:], high[on, 1:])
    return total
