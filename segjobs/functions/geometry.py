"""Small numpy helpers on rings (arrays of n x 2, first point equal to the last) and masks."""

from __future__ import annotations

import numpy as np

from segjobs.functions.segments import CROSS, contacts, sides


def signed_area(ring: np.ndarray) -> float:
    """Positive if the ring runs counter-clockwise (y upwards)."""
    x, y = ring[:, 0], ring[:, 1]
    return float((x[:-1] * y[1:] - x[1:] * y[:-1]).sum() / 2)


def chaikin(ring: np.ndarray, rounds: int) -> np.ndarray:
    """Corners cut at a quarter and three quarters of each edge, so many times; a closed ring stays closed."""
    points = ring[:-1]
    for _ in range(rounds):
        after = np.roll(points, -1, axis=0)
        points = np.stack([0.75 * points + 0.25 * after, 0.25 * points + 0.75 * after], axis=1).reshape(-1, 2)
    return np.concatenate([points, points[:1]])


def kept_points(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """Which points of a closed ring Douglas-Peucker keeps, from its first one and the farthest; at least four stay."""
    if len(ring) <= 4:
        return np.ones(len(ring), bool)
    far = int(((ring - ring[0]) ** 2).sum(axis=1).argmax())
    keep = np.zeros(len(ring), bool)
    keep[[0, far, len(ring) - 1]] = True
    todo = [(0, far), (far, len(ring) - 1)]
    dropped = []
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        k, away = farthest(ring, a, b)
        if away > tolerance:
            keep[k] = True
            todo += [(a, k), (k, b)]
        else:
            dropped.append((away, k))
    for _, k in sorted(dropped, reverse=True):  # a ring needs three corners
        if keep.sum() >= 4:
            break
        keep[k] = True
    return keep if keep.sum() >= 4 else np.ones(len(ring), bool)


def farthest(ring: np.ndarray, a: int, b: int) -> tuple[int, float]:
    """The point between a and b that is farthest from the segment between them, and how far."""
    p, d = ring[a + 1 : b] - ring[a], ring[b] - ring[a]
    length = float(d @ d)
    t = np.clip(p @ d / length, 0, 1)[:, None] if length else np.zeros((len(p), 1))
    away = np.sqrt(((p - t * d) ** 2).sum(axis=1))
    k = int(away.argmax())
    return a + 1 + k, float(away[k])


def simplified(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker on a closed ring, from its first point and the farthest one; at least four points stay."""
    return ring[kept_points(ring, tolerance)]


def simplified_together(xy: np.ndarray, ring: np.ndarray, row: np.ndarray, tolerance: float) -> np.ndarray:
    """Which points stay of closed rings (their points one after another; row: the polygon of each ring) so that no
    shortcut meets what its polygon did not meet before.

    Rings are simplified each for itself. Then all segments of all polygons are indexed; a shortcut that meets its own
    ring, crosses another one, or has left one on its other side gets back the farthest point it leaves out, and so on.
    """
    keep = np.zeros(len(xy), bool)
    begin = np.searchsorted(ring, np.arange(len(row)), "left")
    end = np.searchsorted(ring, np.arange(len(row)), "right")
    for a, b in zip(begin.tolist(), end.tolist(), strict=True):
        keep[a:b] = kept_points(xy[a:b], tolerance)
    several = np.bincount(row)[row] > 1 if len(row) else np.zeros(0, bool)
    live = np.unique(row)  # polygons that changed since they were last found to be fine
    while len(live):
        at = np.flatnonzero(keep & np.isin(row[ring], live))
        a, b = at[:-1], at[1:]
        some = (ring[a] == ring[b]) & (xy[a] != xy[b]).any(axis=1)
        a, b = a[some], b[some]
        of = ring[a]
        e = np.concatenate([xy[a], xy[b]], axis=1)
        count = np.bincount(of, minlength=len(row))
        place = np.arange(len(a)) - (np.cumsum(count) - count)[of]
        bad = np.zeros(len(a), bool)
        for i, j, kind in contacts(e, row[of]):
            gap = np.abs(place[i] - place[j])
            near = (gap == 1) | (gap == count[of[i]] - 1)
            wrong = np.where((of[i] == of[j]) & ~near, True, kind == CROSS)
            bad[i[wrong]] = bad[j[wrong]] = True
        bad |= _jumped(xy, ring, row, begin, a, b, several)
        bad &= b - a > 1
        for i in np.flatnonzero(bad).tolist():
            keep[farthest(xy, int(a[i]), int(b[i]))[0]] = True
        live = np.unique(row[of[bad]])
    return keep


def _jumped(
    xy: np.ndarray,
    ring: np.ndarray,
    row: np.ndarray,
    begin: np.ndarray,
    a: np.ndarray,
    b: np.ndarray,
    several: np.ndarray,
) -> np.ndarray:
    """Whether another ring of the polygon lies between a shortcut and the points that it leaves out: its first point
    does."""
    out = np.zeros(len(a), bool)
    cut = np.flatnonzero((b - a > 1) & several[ring[a]])
    if not len(cut):
        return out
    others: dict[int, np.ndarray] = {}
    for k in cut.tolist():
        polygon = int(row[ring[a[k]]])
        if polygon not in others:
            others[polygon] = np.flatnonzero(row == polygon)
        points = xy[a[k] : b[k] + 1]
        low, high = points.min(axis=0), points.max(axis=0)
        first = xy[begin[others[polygon][others[polygon] != ring[a[k]]]]]
        first = first[((low <= first) & (first <= high)).all(axis=1)]
        if len(first):
            closed = np.concatenate([points, points[:1]])
            odd = np.zeros(len(first), np.int64)
            e = np.concatenate([closed[:-1], closed[1:]], axis=1)
            for p, _, on in sides(first, np.zeros(len(first), np.int64), e, np.zeros(len(e), np.int64)):
                np.add.at(odd, p[~on], 1)
            out[k] = (odd % 2).any()
    return out


def labelled(ys: np.ndarray, xs: np.ndarray) -> np.ndarray:
    """For each pixel the index of the first pixel (by y, then x) of its 4-connected region; pixels ordered so.

    Regions that meet take the lower of their first pixels, all at once, until no two meet. Equal pixels are one.
    """
    root = np.arange(len(ys))
    if not len(ys):
        return root
    width = int(xs.max() - xs.min()) + 2
    place = ys.astype(np.int64) * width + (xs - xs.min())
    sides = []
    for step in (0, 1, width):
        at = np.searchsorted(place, place - step)
        there = np.flatnonzero(place[at] == place - step)
        sides.append((at[there], there))
    a, b = (np.concatenate(side) for side in zip(*sides, strict=True))
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low != high
        if not apart.any():
            return root
        a, b = a[apart], b[apart]
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] != root).any():
            root = root[root]
