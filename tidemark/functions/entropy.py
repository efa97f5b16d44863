"""Sample entropy of long series, in less than square time.

Pairs of templates that are within a distance of each other in every coordinate are counted by merge trees: points in
the order of one coordinate, in blocks of every power of two, each block in the order of the next coordinate. A prefix of
an order is a block of each size that its number has a bit for, so a count needs as many searches as it has bits. With
three coordinates a tree hangs in every block of the first.
"""

from __future__ import annotations

import math

import numpy as np

#: Up to so many templates all pairs are compared, which is faster.
SMALL = 1500


def _bounds(values: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Dense ranks of ``values``, and for each rank those from and to which values are less than ``r`` away, by the
    same subtraction that compares two values."""
    u, rank = np.unique(values, return_inverse=True)
    low, high = np.searchsorted(u, u - r, side="left"), np.searchsorted(u, u + r, side="right")
    at = np.arange(len(u))
    for step in (True, False):  # rounding may put a bound a few places off
        while True:
            k = (low > 0) & (u - u[np.maximum(low - 1, 0)] < r) if step else (low < at) & (u - u[np.minimum(low, len(u) - 1)] >= r)
            if not k.any():
                break
            low = low - k if step else low + k
        while True:
            k = (high < len(u)) & (u[np.minimum(high, len(u) - 1)] - u < r) if step else (high > at + 1) & (u[high - 1] - u >= r)
            if not k.any():
                break
            high = high + k if step else high - k
    return rank, low, high


def _below(order: np.ndarray, ranks: np.ndarray, prefix: np.ndarray, base: np.ndarray, limit: np.ndarray, top: int, n: int) -> np.ndarray:
    """Of the first ``prefix`` points after ``base`` in an order, how many have a rank under ``limit``. ``order`` has the
    points' places, dealt into blocks of ``2**top`` that ``base`` begins."""
    out = np.zeros(len(prefix), np.int64)
    place = np.arange(len(order))
    for level in range(top + 1):
        ask = np.flatnonzero(prefix >> level & 1)
        if not len(ask):
            continue
        keys = np.sort((place >> level) * n + ranks[order])
        block = (base[ask] + (prefix[ask] >> level + 1 << level + 1)) >> level
        out[ask] += np.searchsorted(keys, block * n + limit[ask]) - (block << level)
    return out


def _windows(ranks: list[np.ndarray], low: np.ndarray, high: np.ndarray, prefix: np.ndarray, base: np.ndarray, order: np.ndarray, top: int, n: int) -> np.ndarray:
    """The first ``prefix`` points in an order whose rank is from ``low`` to ``high``."""
    return _below(order, ranks, prefix, base, high, top, n) - _below(order, ranks, prefix, base, low, top, n)


def close_pairs(coordinates: list[np.ndarray], low: np.ndarray, high: np.ndarray) -> int:
    """Pairs of points whose ranks, in two or three coordinates, are each within the other's bounds."""
    n = len(coordinates[0])
    span = int(max(c.max() for c in coordinates)) + 2 if n else 2
    lows, highs = [low[c] for c in coordinates], [high[c] for c in coordinates]
    if n <= SMALL:
        close = np.ones((n, n), bool)
        for c, a, b in zip(coordinates, lows, highs, strict=True):
            close &= (c[None, :] >= a[:, None]) & (c[None, :] < b[:, None])
        return (int(close.sum()) - n) // 2
    width = max(1, (n - 1).bit_length())
    if len(coordinates) == 2:
        x, y = coordinates
        order = np.argsort(x, kind="stable")
        sorted_x, none = x[order], np.zeros(n, np.int64)
        total = 0
        for edge, sign in ((highs[0], 1), (lows[0], -1)):
            prefix = np.searchsorted(sorted_x, edge)
            total += sign * int(_windows(y, lows[1], highs[1], prefix, none, order, width, span).sum())
        return (total - n) // 2
    x, y, z = coordinates
    outer = np.argsort(z, kind="stable")
    sorted_z, place, total = z[outer], np.arange(n), 0
    prefixes = [(np.searchsorted(sorted_z, highs[2]), 1), (np.searchsorted(sorted_z, lows[2]), -1)]
    for level in range(width + 1):
        order = outer[np.lexsort((x[outer], place >> level))]  # blocks in the order of z, each in that of x
        keys = (place >> level) * span + x[order]
        for prefix, sign in prefixes:
            ask = np.flatnonzero(prefix >> level & 1)
            if not len(ask):
                continue
            block = prefix[ask] >> level + 1 << 1
            base = block << level
            for edge, way in ((highs[0], sign), (lows[0], -sign)):
                inside = np.searchsorted(keys, block * span + edge[ask]) - base
                total += way * int(_windows(y, lows[1][ask], highs[1][ask], inside, base, order, level, span).sum())
    return (total - n) // 2


def sample_entropy(series: np.ndarray, sd: float, tolerance: float = 0.2) -> float | None:
    """ln(B / A): pairs of templates of two values that are less than ``tolerance`` deviations apart, and those of three.

    Values that aren't numbers are near nothing. Null for a flat series and where no three are close."""
    if not sd or not sd > 0 or len(series) < 4:
        return None
    known = ~np.isnan(series)
    rank, low, high = _bounds(np.where(known, series, 0.0), tolerance * sd)
    two = np.flatnonzero(known[:-2] & known[1:-1])
    three = np.flatnonzero(known[:-2] & known[1:-1] & known[2:])
    b = close_pairs([rank[two], rank[two + 1]], low, high)
    a = close_pairs([rank[three], rank[three + 1], rank[three + 2]], low, high)
    return math.log(b / a) if a > 0 else None
