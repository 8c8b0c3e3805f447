import numpy as np
import pytest

from segjobs.functions.geometry import chaikin, labelled, signed_area, simplified
from segjobs.functions.overlay import dissolved, doubled_area, polygons_of
from segjobs.operators.augment import METHODS
from segjobs.operators.clip import burn_rows
from segjobs.operators.validate import problem

SQUARE = np.array([(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)], float)


def box(x, y, w, h):
    return np.array([(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)], float)


def union_area(polygons):
    return sum(signed_area(r) for rings in dissolved(polygons) for r in rings)


def test_chaikin_doubles_points_and_stays_closed():
    once = chaikin(SQUARE, 1)
    assert len(once) == 9 and (once[0] == once[-1]).all()
    assert signed_area(once) == pytest.approx(0.875)
    assert len(chaikin(SQUARE, 3)) == 33


def test_simplified_drops_small_zigzags_only():
    zigzag = np.array([(0, 0), (2, 0.1), (4, 0), (6, 0.1), (8, 0), (8, 8), (0, 8), (0, 0)], float)
    assert len(simplified(zigzag, 0.5)) == 5
    assert len(simplified(zigzag, 0.01)) == len(zigzag)
    assert len(simplified(SQUARE, 100)) >= 4


def test_dissolve_overlap_edge_and_corner():
    assert union_area([[box(0, 0, 2, 2)], [box(1, 1, 2, 2)]]) == pytest.approx(7)
    assert len(dissolved([[box(0, 0, 2, 2)], [box(2, 0, 2, 2)]])) == 1
    corner = dissolved([[box(0, 0, 2, 2)], [box(2, 2, 2, 2)]])
    assert len(corner) == 2 and sum(signed_area(r) for p in corner for r in p) == pytest.approx(8)
    ring = dissolved([[box(0, 0, 3, 1)], [box(0, 2, 3, 1)], [box(0, 0, 1, 3)], [box(2, 0, 1, 3)]])
    assert len(ring) == 1 and len(ring[0]) == 2


def test_dissolve_matches_counted_cells():
    random = np.random.default_rng(3)
    for _ in range(20):
        boxes = [(*random.integers(0, 12, 2), *random.integers(1, 6, 2)) for _ in range(8)]
        cells = {(x + i, y + j) for x, y, w, h in boxes for i in range(w) for j in range(h)}
        made = dissolved([[box(*map(float, b))] for b in boxes])
        assert sum(signed_area(r) for p in made for r in p) == pytest.approx(len(cells))
        again = dissolved(made)
        assert len(again) == len(made)


def test_dissolve_of_slanted_shapes():
    triangle = np.array([(0, 0), (4, 0), (0, 4), (0, 0)], float)
    other = np.array([(4, 4), (0, 4), (4, 0), (4, 4)], float)
    assert union_area([[triangle], [other]]) == pytest.approx(16)
    assert union_area([[triangle], [triangle.copy()]]) == pytest.approx(8)


@pytest.mark.parametrize(
    "mask",
    [
        "11111 10001 10101 10001 11111",
        "11000 11000 00110 00110 00000",
        "10101 10101 11111 00000 00000",
        "11111 11111 11111 11111 11111",
    ],
)
def test_labels_and_rings_of_small_masks(mask):
    m = np.array([[int(c) for c in row] for row in mask.split()])
    y, x = np.nonzero(m)
    label = labelled(y, x)
    for k in np.unique(label):
        mine = set(zip(y[label == k].tolist(), x[label == k].tolist(), strict=True))
        edges = []
        for r, c in mine:
            for near, a, b in (
                ((r - 1, c), (c, r), (c + 1, r)),
                ((r, c + 1), (c + 1, r), (c + 1, r + 1)),
                ((r + 1, c), (c + 1, r + 1), (c, r + 1)),
                ((r, c - 1), (c, r + 1), (c, r)),
            ):
                if near not in mine:
                    edges.append((a, b))
        e = np.array([(*p, *q) for p, q in edges])
        (rings,) = polygons_of(e, np.zeros(len(e), np.int64), 1)[0]
        assert sum(doubled_area(ring) for ring in rings) == 2 * len(mine)
        # Burning the rings gives the pixels back.
        parts = [[[{"x": p[0], "y": -p[1]} for p in ring] for ring in rings]]
        assert {(r, c) for r, a, b in burn_rows(parts, 0, 0, 1, 9, 9) for c in range(a, b + 1)} == mine


def test_labels_are_four_connected():
    y, x = np.nonzero(np.array([[1, 0], [0, 1]]))
    assert len(set(labelled(y, x).tolist())) == 2


def test_augmentations_on_a_small_array():
    m = np.array([[1, 2, 3], [4, 5, 6]])
    h, w = m.shape
    wanted = {
        "Rotate 90": lambda i, j: m[j, w - 1 - i], "Rotate 180": lambda i, j: m[
            h - 1 - i, w - 1 - j
        ], "Rotate 270": lambda i, j: m[h - 1 - j, i],
        "Mirror": lambda i, j: m[j, i], "Flip H": lambda i, j: m[i, w - 1 - j], "Flip V": lambda i, j: m[
            h - 1 - i, j
        ], "Original": lambda i, j: m[i, j],
    }
    for name, f in wanted.items():
        out = METHODS[name][1](m)
        assert out.shape == ((w, h) if name in ("Rotate 90", "Rotate 270", "Mirror") else (h, w))
        assert all(out[i, j] == f(i, j) for i in range(out.shape[0]) for j in range(out.shape[1])), name
    four = m
    for _ in range(4):
        four = METHODS["Rotate 90"][1](four)
    assert (four == m).all()


def points(ring):
    return [{"x": float(x), "y": float(y)} for x, y in ring]


def test_problems_of_polygons():
    assert problem(None) == "null" and problem([]) == "empty" and problem([[]]) == "empty"
    assert problem([[points(SQUARE[:3])]]) == "short"
    assert problem([[points(SQUARE[:4])]]) == "open"
    assert problem([[points([(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)])]]) == "crossing"
    assert problem([[points(box(0, 0, 4, 4)), points(box(9, 9, 1, 1))]]) == "hole outside"
    assert problem([[points(box(0, 0, 4, 4)), points(box(1, 1, 1, 1))]]) is None


def test_labels_equal_a_flood_fill():
    random = np.random.default_rng(11)
    for share in (0.2, 0.55, 0.6, 0.9):
        grid = random.random((23, 31)) < share
        ys, xs = np.nonzero(grid)
        first = {}
        for start in zip(ys.tolist(), xs.tolist(), strict=True):
            todo = [] if start in first else [start]
            while todo:
                y, x = todo.pop()
                if 0 <= y < 23 and 0 <= x < 31 and grid[y, x] and (y, x) not in first:
                    first[y, x] = start
                    todo += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
        got = labelled(ys, xs + 7)
        assert [(int(ys[k]), int(xs[k])) for k in got] == [first[p] for p in zip(ys.tolist(), xs.tolist(), strict=True)]
    assert len(labelled(np.empty(0, np.int64), np.empty(0, np.int64))) == 0


def test_rings_do_not_depend_on_the_order_of_edges():
    made = dissolved([[box(0, 0, 4, 4)], [box(4, 4, 3, 3)], [box(2, 1, 5, 1)]])
    e = np.concatenate([np.concatenate([r[:-1], r[1:]], axis=1) for rings in made for r in rings]).astype(np.int64)
    whole = [[r.tolist() for r in rings] for rings in polygons_of(e, np.zeros(len(e), np.int64), 1)[0]]
    assert all(r[0] == min(r) for rings in whole for r in rings)
    for seed in range(5):
        some = e[np.random.default_rng(seed).permutation(len(e))]
        assert [[r.tolist() for r in rings] for rings in polygons_of(some, np.zeros(len(e), np.int64), 1)[0]] == whole
