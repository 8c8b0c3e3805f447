"""An index of line segments by ranges of x, and tests on doubles that are exact.

Segments belong to groups, of which any number is looked at in one call: x is replaced by its rank within the group, so
that segments of different groups never meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from segjobs.functions.overlay import ranges


def whole(values: np.ndarray) -> np.ndarray:
    """Doubles as exact whole numbers of one common unit (Python's, of any size)."""
    share, power = np.frexp(values)
    lowest = power[values != 0].min(initial=0)
    shift = np.where(values == 0, 0, power - lowest).astype(object)
    return np.left_shift((share * (1 << 53)).astype(np.int64).astype(object), shift)


def orientation(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """1 where c lies to the left of the way from a to b, -1 to the right, 0 on its line. Rounding is told from
    the size of what is subtracted; where it might matter, whole numbers decide."""
    left, right = (b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]), (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0])
    value = left - right
    out = np.sign(value).astype(np.int64)
    unsure = np.flatnonzero(np.abs(value) <= 1e-15 * (np.abs(left) + np.abs(right)))
    unsure = unsure[
        (a[unsure] != b[unsure]).any(axis=1)
        & (a[unsure] != c[unsure]).any(axis=1)
        & (b[unsure] != c[unsure]).any(axis=1)
    ]
    level = ((a[unsure, 1] == b[unsure, 1]) & (b[unsure, 1] == c[unsure, 1])) | (
        (a[unsure, 0] == b[unsure, 0]) & (b[unsure, 0] == c[unsure, 0])
    )
    unsure = unsure[~level]  # on one upright or level line the products above are zeros
    if len(unsure):
        n = whole(np.stack([a[unsure], b[unsure], c[unsure]], axis=1))
        exact = (n[:, 1, 0] - n[:, 0, 0]) * (n[:, 2, 1] - n[:, 0, 1]) - (n[:, 1, 1] - n[:, 0, 1]) * (
            n[:, 2, 0] - n[:, 0, 0]
        )
        out[unsure] = np.array([(v > 0) - (v < 0) for v in exact], np.int64)
    same = (a == b).all(axis=1) | (a == c).all(axis=1) | (b == c).all(axis=1)
    out[same] = 0
    return out


def ranked(group: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Ranks of values within and across groups: equal values of a group share one, groups follow each other."""
    groups, flat = np.tile(group, len(values)), np.concatenate(values)
    order = np.lexsort((flat, groups))
    new = np.zeros(len(flat), np.int64)
    new[1:] = (flat[order[1:]] != flat[order[:-1]]) | (groups[order[1:]] != groups[order[:-1]])
    out = np.empty(len(flat), np.int64)
    out[order] = np.cumsum(new)
    return np.split(out, len(values)) if len(group) else [out for _ in values]


#: How two segments meet.
TOUCH, CROSS = 1, 2


def contacts(e: np.ndarray, group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, kind) of segments (n x 4) of one group that share a point: TOUCH at an end of one of them, or CROSS if
    they cross inside both or share a stretch."""
    low, high = np.minimum(e[:, :2], e[:, 2:]), np.maximum(e[:, :2], e[:, 2:])
    first, last = ranked(group, low[:, 0], high[:, 0])
    order = np.argsort(first, kind="stable")
    for k, m in ranges(np.arange(1, len(e) + 1), np.searchsorted(first[order], last[order], "right")):
        i, j = order[k], order[m]
        near = (low[i, 1] <= high[j, 1]) & (low[j, 1] <= high[i, 1])
        i, j = i[near], j[near]
        a, b, c, d = e[i, :2], e[i, 2:], e[j, :2], e[j, 2:]
        o1, o2, o3, o4 = orientation(a, b, c), orientation(a, b, d), orientation(c, d, a), orientation(c, d, b)
        on = (o1 * o2 <= 0) & (o3 * o4 <= 0)
        shared = np.minimum(high[i], high[j]) - np.maximum(low[i], low[j])
        along = (o1 == 0) & (o2 == 0) & (o3 == 0) & (o4 == 0)
        kind = np.where((o1 * o2 < 0) & (o3 * o4 < 0) | along & (shared > 0).any(axis=1), CROSS, TOUCH)
        yield i[on], j[on], kind[on]


def sides(points: np.ndarray, group: np.ndarray, e: np.ndarray, e_group: np.ndarray) -> Iterator[
    tuple[np.ndarray, np.ndarray, np.ndarray]
]:
    """(point, segment, on) of points and segments of one group: segments that lie under a point by the rule of
    half-open ranges of x, or (on) hold it."""
    back = e[:, 0] > e[:, 2]
    e = np.where(back[:, None], e[:, [2, 3, 0, 1]], e)
    n, m = len(points), len(e)
    flat = np.concatenate([points[:, 0], e[:, 0], e[:, 2]])
    (rank,) = ranked(np.concatenate([group, e_group, e_group]), flat)
    x, first, last = rank[:n], rank[n : n + m], rank[n + m :]
    order = np.argsort(x, kind="stable")
    for k, p in ranges(np.searchsorted(x[order], first, "left"), np.searchsorted(x[order], last, "right")):
        p = order[p]
        near = np.minimum(e[k, 1], e[k, 3]) <= points[p, 1]
        k, p = k[near], p[near]
        side = orientation(e[k, :2], e[k, 2:], points[p])
        on = (side == 0) & (points[p, 1] <= np.maximum(e[k, 1], e[k, 3]))
        under = (side > 0) & (x[p] < last[k])
        some = on | under
        yield p[some], k[some], on[some]
