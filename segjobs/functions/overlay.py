"""Unions of polygons on a whole-number grid, for many groups of polygons at once.

Coordinates are whole numbers of at most ``BITS`` bits, so every test of sides is exact in 64 bits. Edges are directed,
with the inside on their left. They are noded by iterated snap rounding: where two edges cross, the nearest grid point
becomes a vertex, and an edge that passes through the unit square about a vertex is led through it, until nothing is
left to do. Then edges meet in vertices alone, each has a winding number on either side, and those with a covered side
and an open one are the boundary of the union; around every vertex as many of them arrive as leave, so that rings always
close.

Groups are laid side by side along x, and whatever is compared is found by ranges of x: groups never meet, and one call
of numpy serves them all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BITS = 28
#: Polygons that are united in one step; more are united by so many, and then the unions.
FAN = 6
_AT_ONCE = 1 << 20


def grid_of(low: float, high: float) -> float:
    """The grid step, a power of two, by which coordinates from low to high have at most BITS bits."""
    return 2.0 ** (int(np.ceil(np.log2(max(high - low, 1e-300)))) - BITS)


def ranges(first: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(k, i) for every i of first[k]..last[k] - 1; in parts of bounded size, unless one range is longer."""
    size = np.maximum(last - first, 0)
    total = np.cumsum(size)
    at = 0
    while at < len(size):
        done = total[at - 1] if at else 0
        to = max(int(np.searchsorted(total, done + _AT_ONCE, "right")), at + 1)
        n = size[at:to]
        k = np.repeat(np.arange(at, to), n)
        yield k, first[k] + np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)
        at = to


def cross(ax, ay, bx, by):
    return ax * by - ay * bx


def normalized(e: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from the left to the right (or upwards), each once, by x, with the sum of their ways; those that cancel are
    gone."""
    back = (e[:, 0] > e[:, 2]) | ((e[:, 0] == e[:, 2]) & (e[:, 1] > e[:, 3]))
    e, w = np.where(back[:, None], e[:, [2, 3, 0, 1]], e), np.where(back, -w, w)
    order = np.lexsort(e.T[::-1])
    e, w = e[order], w[order]
    new = np.ones(len(e), bool)
    new[1:] = (e[1:] != e[:-1]).any(axis=1)
    first = np.flatnonzero(new)
    total = np.add.reduceat(w, first) if len(first) else w
    kept = (total != 0) & (e[first, :2] != e[first, 2:]).any(axis=1)
    return e[first][kept], total[kept]


def crossings(e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, nearest grid point) of pairs of edges, ordered by x, that cross inside both."""
    found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, 2), np.int64))]
    low, high = np.minimum(e[:, 1], e[:, 3]), np.maximum(e[:, 1], e[:, 3])
    for i, j in ranges(np.arange(1, len(e) + 1), np.searchsorted(e[:, 0], e[:, 2], "right")):
        near = (low[i] <= high[j]) & (low[j] <= high[i])
        i, j = i[near], j[near]
        a, c = e[i], e[j]
        dx, dy, fx, fy, gx, gy = a[:, 2] - a[:, 0], a[:, 3] - a[:, 1], c[:, 2] - c[:, 0], c[:, 3] - c[:, 1], c[
            :, 0
        ] - a[:, 0], c[:, 1] - a[:, 1]
        o1 = cross(dx, dy, gx, gy)
        o2 = cross(dx, dy, gx + fx, gy + fy)
        o3 = -cross(fx, fy, gx, gy)
        o4 = cross(fx, fy, dx - gx, dy - gy)
        both = (np.sign(o1) * np.sign(o2) < 0) & (np.sign(o3) * np.sign(o4) < 0)
        i, j, o3, o4 = i[both], j[both], o3[both], o4[both]
        if len(i):
            t = o3 / (o3 - o4).astype(np.float64)
            step = np.rint(np.stack([dx[both], dy[both]], axis=1) * t[:, None]).astype(np.int64)
            found.append((i, j, e[i, :2] + step))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def near_points(e: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edge, point) where an edge passes through the unit square about a point that is not its end; points by x."""
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    low, high = np.minimum(e[:, 1], e[:, 3]), np.maximum(e[:, 1], e[:, 3])
    for k, p in ranges(np.searchsorted(points[:, 0], e[:, 0], "left"), np.searchsorted(points[:, 0], e[:, 2], "right")):
        y = points[p, 1]
        near = (low[k] <= y) & (y <= high[k])
        k, p = k[near], p[near]
        a, q = e[k], points[p]
        dx, dy = a[:, 2] - a[:, 0], a[:, 3] - a[:, 1]
        away = np.abs(cross(dx, dy, q[:, 0] - a[:, 0], q[:, 1] - a[:, 1]))
        end = (q == a[:, :2]).all(axis=1) | (q == a[:, 2:]).all(axis=1)
        on = (2 * away <= np.abs(dx) + np.abs(dy)) & ~end
        found.append((k[on], p[on]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def distinct_points(points: np.ndarray) -> np.ndarray:
    """By x, then y."""
    points = points[np.lexsort((points[:, 1], points[:, 0]))]
    new = np.ones(len(points), bool)
    new[1:] = (points[1:] != points[:-1]).any(axis=1)
    return points[new]


def noded(e: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that meet in their ends alone, with the sums of their ways.

    An edge is led through vertices in its box that go on in x and in y alike; what would lead it back waits for the
    next pass. So its parts' widths and heights add up to its own, the sum of their squares falls, and this ends.
    """
    e, w = normalized(e, w)
    while len(e):
        i, j, at = crossings(e)
        points = distinct_points(np.concatenate([e[:, :2], e[:, 2:], at]))
        k, p = near_points(e, points)
        owner = np.concatenate([k, i, j])
        cut = np.concatenate([points[p], at, at])
        a = e[owner]
        inner = (cut != a[:, :2]).any(axis=1) & (cut != a[:, 2:]).any(axis=1)
        if not inner.any():
            return e, w
        owner, cut, a = owner[inner], cut[inner], a[inner]
        way = np.abs(cut[:, 1] - a[:, 1])
        order = np.lexsort((way, cut[:, 0], owner))
        owner, cut, way = owner[order], cut[order], way[order]
        reached = owner * (1 << (BITS + 2)) + way
        onward = reached == np.maximum.accumulate(reached)
        owner, cut = owner[onward], cut[onward]
        whole = np.ones(len(e), bool)
        whole[owner] = False
        first = np.concatenate([[True], owner[1:] != owner[:-1]])
        last = np.concatenate([first[1:], [True]])
        begin = np.where(first[:, None], e[owner, :2], np.roll(cut, 1, axis=0))
        ends = np.concatenate([cut[last], e[owner[last], 2:]], axis=1)
        e, w = normalized(
            np.concatenate([e[whole], np.concatenate([begin, cut], axis=1), ends]),
            np.concatenate([w[whole], w[owner], w[owner[last]]]),
        )
    return e, w


def below(e: np.ndarray, points: np.ndarray, upright: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(edge, point) where an edge lies under a point; points are doubled. Upright marks those that look a little to the
    left of their x, others look a little to its right."""
    level = np.flatnonzero(e[:, 0] != e[:, 2])
    for left in (False, True):
        some = np.flatnonzero(upright == left)
        some = some[np.argsort(points[some, 0], kind="stable")]
        x, side = points[some, 0], "right" if left else "left"
        for k, i in ranges(np.searchsorted(x, 2 * e[level, 0], side), np.searchsorted(x, 2 * e[level, 2], side)):
            f, q = e[level[k]], points[some[i]]
            over = cross(f[:, 2] - f[:, 0], f[:, 3] - f[:, 1], q[:, 0] - 2 * f[:, 0], q[:, 1] - 2 * f[:, 1]) > 0
            yield level[k[over]], some[i[over]]


def outline(e: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Of noded edges those with a covered side and an open one, directed with the covered side on their left."""
    upright = e[:, 0] == e[:, 2]
    known = np.zeros(len(e), np.int64)
    for f, i in below(e, e[:, :2] + e[:, 2:], upright):
        np.add.at(known, i, w[f])
    left = np.where(upright, known, known + w)
    right = left - w
    return np.concatenate([e[(left > 0) & (right <= 0)], e[(right > 0) & (left <= 0)][:, [2, 3, 0, 1]]])


def apart(e: np.ndarray, group: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """e with the groups 0..n - 1 side by side along x; the shift of each, and where it begins."""
    low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
    for c in (0, 2):
        np.minimum.at(low, group, e[:, c])
        np.maximum.at(high, group, e[:, c])
    width = np.where(low <= high, high - low, 0) + 2
    begin = np.cumsum(width) - width
    shift = np.where(low <= high, begin - low, 0)
    moved = e.copy()
    moved[:, 0] += shift[group]
    moved[:, 2] += shift[group]
    return moved, shift, begin


def united(e: np.ndarray, piece: np.ndarray, group_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edges, group): the boundary of each group's union. piece: the piece of each edge; group_of: each piece's group,
    ascending.

    Pieces of a group are united FAN at a time, neighbours along x first, then these unions, and so on: what many
    stacked pieces cover is soon a few edges.
    """
    while True:
        left = np.full(len(group_of), np.iinfo(np.int64).max)
        np.minimum.at(left, piece, e[:, 0])
        order = np.lexsort((left, group_of))
        owner = group_of[order]
        first = np.searchsorted(owner, owner, "left")
        part = (np.arange(len(owner)) - first) // FAN
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (part[1:] != part[:-1])
        number = np.empty(len(owner), np.int64)
        number[order] = np.cumsum(new) - 1
        groups = owner[new]
        moved, shift, begin = apart(e, number[piece], len(groups))
        e = outline(*noded(moved, np.ones(len(moved), np.int64)))
        piece = np.searchsorted(begin, np.minimum(e[:, 0], e[:, 2]), "right") - 1
        e[:, 0] -= shift[piece]
        e[:, 2] -= shift[piece]
        group_of = groups
        if len(np.unique(groups)) == len(groups):
            return e, groups[piece]


def vertices(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers, by x and y, of the vertices at which each edge begins and ends."""
    points = np.concatenate([e[:, :2], e[:, 2:]])
    order = np.lexsort((points[:, 1], points[:, 0]))
    new = np.zeros(len(points), np.int64)
    new[1:] = (points[order[1:]] != points[order[:-1]]).any(axis=1)
    number = np.empty(len(points), np.int64)
    number[order] = np.cumsum(new)
    return number[: len(e)], number[len(e) :]


def successors(e: np.ndarray, starts: np.ndarray, ends: np.ndarray, inner: np.ndarray | None = None) -> np.ndarray:
    """For each edge of outlines the one that follows it: of several, that with the sharpest turn to the left. With
    inner, -1 for edges whose end it does not mark."""
    order = np.argsort(starts, kind="stable")
    first, last = (np.searchsorted(starts[order], ends, side) for side in ("left", "right"))
    follow = order[np.minimum(first, len(order) - 1)]
    if inner is not None:
        follow[~inner] = -1
        last = np.where(inner, last, first)
    way = e[:, 2:] - e[:, :2]
    for k in np.flatnonzero(last - first > 1).tolist():  # corners in which polygons or holes meet
        d, best = way[k].tolist(), None
        for w in order[first[k] : last[k]].tolist():
            o = way[w].tolist()
            to_left = cross(*d, *o) > 0
            if best is None or (to_left > best[1] if to_left != best[1] else cross(*best[2], *o) > 0):
                best = (w, to_left, o)
        follow[k] = best[0]
    return follow


def rings_of(e: np.ndarray) -> list[np.ndarray]:
    """Simple closed rings (numbers of edges in order) of outlines: a walk that comes back to a vertex leaves a ring
    there."""
    starts, ends = vertices(e)
    follow = successors(e, starts, ends).tolist()
    often = np.bincount(starts)[starts] > 1
    seen, rings = [False] * len(e), []
    for start in np.argsort(starts, kind="stable").tolist():
        walk, k = [], start
        while not seen[k]:
            seen[k] = True
            walk.append(k)
            k = follow[k]
        if walk:
            own = np.array(walk)
            rings += simple_rings(walk, starts[own].tolist()) if often[own].any() else [own]
    return rings


def simple_rings(walk: list[int], at: list[int]) -> list[np.ndarray]:
    """A walk over edges, which begin at the vertices ``at``, in rings that come to no vertex twice."""
    out, path, where = [], [], {}
    for k, vertex in zip(walk, at, strict=True):
        if vertex in where:
            cut = where[vertex]
            out.append(np.array([x for x, _ in path[cut:]]))
            for _, gone in path[cut:]:
                del where[gone]
            del path[cut:]
        where[vertex] = len(path)
        path.append((k, vertex))
    return [*out, np.array([x for x, _ in path])]


def corners(e: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """The closed points of a ring, from its first in order, without those on straight runs."""
    p = e[ring, :2]
    before, after = p - np.roll(p, 1, axis=0), np.roll(p, -1, axis=0) - p
    p = p[cross(before[:, 0], before[:, 1], after[:, 0], after[:, 1]) != 0]
    if not len(p):
        return np.empty((0, 2), np.int64)
    start = int(np.lexsort((p[:, 1], p[:, 0]))[0])
    p = np.roll(p, -start, axis=0)
    return np.concatenate([p, p[:1]])


def doubled_area(p: np.ndarray) -> int:
    """Twice the signed area of a closed ring, exact."""
    q = p - p[0]
    terms = cross(q[:-1, 0], q[:-1, 1], q[1:, 0], q[1:, 1])
    return int(terms.sum()) if len(q) < 32 else sum(terms.tolist())


def polygons_of(e: np.ndarray, group: np.ndarray, n: int) -> list[list[list[np.ndarray]]]:
    """For each group 0..n - 1 its polygons, each a shell and then its holes, of outlines. Polygons that meet in corners
    alone stay separate. A hole belongs to the smallest shell around it, by exact counts of the shell's edges below."""
    out: list[list[list[np.ndarray]]] = [[] for _ in range(n)]
    if not len(e):
        return out
    moved, shift, begin = apart(e, group, n)
    rings = rings_of(moved)
    points = [corners(moved, r) for r in rings]
    area = np.array([doubled_area(p) if len(p) else 0 for p in points], object)
    of = np.searchsorted(begin, [int(moved[r[0], 0]) for r in rings], "right") - 1
    back = lambda k: points[k] - np.array([shift[of[k]], 0])
    shells = [k for k in range(len(rings)) if area[k] > 0]
    holes = [k for k in range(len(rings)) if area[k] < 0]
    made = {k: [back(k)] for k in shells}
    for k in shells:
        out[of[k]].append(made[k])
    if holes:
        edge = np.concatenate([rings[k] for k in shells])
        shell_of = np.repeat(shells, [len(rings[k]) for k in shells])
        first = moved[[rings[k][0] for k in holes]]
        low = np.where((moved[edge, 0] > moved[edge, 2])[:, None], moved[edge][:, [2, 3, 0, 1]], moved[edge])
        counts: dict[tuple[int, int], int] = {}
        for f, i in below(low, first[:, :2] + first[:, 2:], np.zeros(len(holes), bool)):
            both, times = np.unique(np.stack([i, shell_of[f]]), axis=1, return_counts=True)
            for h, s, c in zip(*both.tolist(), times.tolist(), strict=True):
                counts[h, s] = counts.get((h, s), 0) + c
        around: dict[int, list[int]] = {}
        for (h, s), c in counts.items():
            if c % 2:
                around.setdefault(h, []).append(s)
        for h, k in enumerate(holes):
            if h in around:
                made[min(around[h], key=lambda s: area[s])].append(back(k))
    return out


def directed(points: np.ndarray, ring_sizes: np.ndarray, is_shell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edges, ring) of closed rings of grid points, one after another, turned so that the inside is on their left."""
    n = len(points)
    ring = np.repeat(np.arange(len(ring_sizes)), ring_sizes)
    if n < 2:
        return np.empty((0, 4), np.int64), ring[:0]
    inside = ring[1:] == ring[:-1]
    e, ring = np.concatenate([points[:-1], points[1:]], axis=1)[inside], ring[1:][inside]
    first = points[np.minimum(np.cumsum(ring_sizes) - ring_sizes, n - 1)][ring]
    term = cross(e[:, 0] - first[:, 0], e[:, 1] - first[:, 1], e[:, 2] - first[:, 0], e[:, 3] - first[:, 1])
    area = np.bincount(ring, term.astype(np.float64), len(ring_sizes))
    turn = ((area > 0) != is_shell)[ring]
    return np.where(turn[:, None], e[:, [2, 3, 0, 1]], e), ring


def clipped(e: np.ndarray, axis: int, bound: int, keep_below: bool) -> np.ndarray:
    """Directed edges of closed rings cut to one side of a line; the line closes them again.

    What lies beyond is pressed onto the line, where ways to and fro cancel. A cut point depends on its edge alone, so
    that both sides get the same.
    """
    a, b, o = e[:, axis], e[:, axis + 2], 1 - axis
    through = (a < bound) & (b > bound) | (b < bound) & (a > bound)
    some = e[through]
    if len(some):
        back = some[:, axis] > some[:, axis + 2]
        p, q = np.where(back[:, None], some[:, 2:], some[:, :2]), np.where(back[:, None], some[:, :2], some[:, 2:])
        share = (bound - p[:, axis]) / (q[:, axis] - p[:, axis]).astype(np.float64)
        point = np.empty((len(some), 2), np.int64)
        point[:, axis] = bound
        point[:, o] = p[:, o] + np.rint((q[:, o] - p[:, o]) * share).astype(np.int64)
        e = np.concatenate(
            [e[~through], np.concatenate([some[:, :2], point], axis=1), np.concatenate([point, some[:, 2:]], axis=1)]
        )
    e = e.copy()
    press = np.minimum if keep_below else np.maximum
    for c in (axis, axis + 2):
        e[:, c] = press(e[:, c], bound)
    on = (e[:, axis] == bound) & (e[:, axis + 2] == bound)
    low, high, way = np.minimum(e[on, o], e[on, o + 2]), np.maximum(e[on, o], e[on, o + 2]), np.where(
        e[on, o + 2] > e[on, o], 1, -1
    )
    line, low, high, way = cancelled(np.zeros(len(low), np.int64), low, high, way)
    made = np.full((len(low), 4), bound, np.int64)
    made[:, o], made[:, o + 2] = np.where(way > 0, low, high), np.where(way > 0, high, low)
    return np.concatenate([e[~on], np.repeat(made, np.abs(way), axis=0)])


def cancelled(line: np.ndarray, low: np.ndarray, high: np.ndarray, way: np.ndarray) -> tuple[
    np.ndarray, np.ndarray, np.ndarray, np.ndarray
]:
    """(line, low, high, net way) of stretches of lines where the ways of what lies on them do not cancel, each
    joined with the next of the same way."""
    on, at = np.concatenate([line, line]), np.concatenate([low, high])
    step = np.concatenate([way, -way])
    order = np.lexsort((at, on))
    on, at, step = on[order], at[order], step[order]
    new = np.ones(len(at), bool)
    new[1:] = (on[1:] != on[:-1]) | (at[1:] != at[:-1])
    first = np.flatnonzero(new)
    on, at, step = on[first], at[first], np.add.reduceat(step, first) if len(first) else step
    turns = step != 0  # elsewhere a stretch goes on
    on, at = on[turns], at[turns]
    net = np.cumsum(step[turns])  # 0 at the end of each line
    live = np.flatnonzero(net != 0)
    return on[live], at[live], at[np.minimum(live + 1, len(at) - 1)], net[live]


def in_cells(e: np.ndarray, cell: int) -> list[tuple[int, int, np.ndarray]]:
    """(cx, cy, edges) of closed rings for every cell of a grid that they reach into: halved again and again."""
    out: list[tuple[int, int, np.ndarray]] = []
    low, high = np.minimum(e[:, :2], e[:, 2:]).min(axis=0) // cell, (
        np.maximum(e[:, :2], e[:, 2:]).max(axis=0) - 1
    ) // cell
    todo = [(e, *low.tolist(), *np.maximum(low, high).tolist())]
    while todo:
        own, x0, y0, x1, y1 = todo.pop()
        if not len(own):
            continue
        if x0 == x1 and y0 == y1:
            out.append((x0, y0, own))
        elif x1 - x0 >= y1 - y0:
            m = (x0 + x1) // 2 + 1
            todo += [
                (clipped(own, 0, m * cell, True), x0, y0, m - 1, y1), (clipped(own, 0, m * cell, False), m, y0, x1, y1)
            ]
        else:
            m = (y0 + y1) // 2 + 1
            todo += [
                (clipped(own, 1, m * cell, True), x0, y0, x1, m - 1), (clipped(own, 1, m * cell, False), x0, m, x1, y1)
            ]
    return out


def dissolved(polygons: list[list[np.ndarray]]) -> list[list[np.ndarray]]:
    """The union of polygons (closed rings of doubles, shell first) as polygons, on a grid of ``BITS`` bits over all of
    them."""
    rings = [r for own in polygons for r in own]
    flat = np.concatenate(rings)
    low, high = flat.min(axis=0), flat.max(axis=0)
    grid = grid_of(0.0, float((high - low).max()))
    origin = np.floor(low / grid)
    shell = np.array([k == 0 for own in polygons for k in range(len(own))])
    e, ring = directed((np.rint(flat / grid) - origin).astype(np.int64), np.array([len(r) for r in rings]), shell)
    piece = np.repeat(np.arange(len(polygons)), [len(own) for own in polygons])[ring]
    e, group = united(e, piece, np.zeros(len(polygons), np.int64))
    return [[(r + origin) * grid for r in rings] for rings in polygons_of(e, group, 1)[0]]
