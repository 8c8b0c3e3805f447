"""Unions, validity and simplification of slanted polygons, by brute force and counted rasters."""

import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from segjobs.functions import nested, overlay
from segjobs.functions.geometry import kept_points, signed_area, simplified_together
from segjobs.functions.segments import orientation
from segjobs.operators import clean, polygonize, rings
from segjobs.operators.validate import problem, problems

PLACES = [((0.0, 0.0), 1.0), ((500000.37, 5000000.21), 1.0), ((12.5, 41.9), 1e-5)]


def star(r, centre, radius, k=None):
    """A random polygon around its centre, without crossings."""
    k = k or int(r.integers(3, 9))
    a = (np.arange(k) + 0.4 * r.random(k)) * 2 * np.pi / k
    q = radius * (0.3 + 0.7 * r.random(k))
    p = np.stack([centre[0] + q * np.cos(a), centre[1] + q * np.sin(a)], axis=1)
    return np.concatenate([p, p[:1]])


def inside(polygons, points):
    """By parity of crossings, polygon by polygon."""
    out = np.zeros(len(points), bool)
    for rings in polygons:
        n = np.zeros(len(points), int)
        for ring in rings:
            for (ax, ay), (bx, by) in zip(ring[:-1], ring[1:], strict=True):
                over = (ay > points[:, 1]) != (by > points[:, 1])
                if ay != by:
                    n += over & (points[:, 0] < ax + (points[:, 1] - ay) * (bx - ax) / (by - ay))
        out |= n % 2 == 1
    return out


def rows_of(polygons):
    return [[[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings] for rings in polygons]


@pytest.mark.parametrize("seed", range(60))
def test_union_covers_what_its_polygons_cover(seed):
    r = np.random.default_rng(seed)
    origin, scale = PLACES[seed % 3]
    polygons = [[star(r, r.random(2) * 40, 8) * scale + origin] for _ in range(int(r.integers(2, 30)))]
    made = overlay.dissolved(polygons)
    grid = np.stack(np.meshgrid(np.linspace(-8, 48, 70), np.linspace(-8, 48, 70)), axis=-1).reshape(-1, 2) + r.random(
        2
    ) / 10
    assert (inside(polygons, grid * scale + origin) == inside(made, grid * scale + origin)).all()
    near = [[(ring - origin) / scale for ring in rings] for rings in made]
    assert all(signed_area(rings[0]) > 0 and all(signed_area(h) < 0 for h in rings[1:]) for rings in near)
    whole = [[np.round((ring - origin) / scale * (1 << 20)) for ring in rings] for rings in made]
    assert all(problem(rows_of([rings])) is None for rings in near), whole
    again = overlay.dissolved(made)
    area = lambda ps: sum(signed_area((ring - origin) / scale) for rings in ps for ring in rings)
    assert len(again) == len(made) and abs(area(again) - area(made)) < 1e-4


def test_many_stacked_polygons_take_seconds():
    r = np.random.default_rng(5)
    polygons = [[star(r, r.random(2) * 2, 8, 7)] for _ in range(3200)]
    began = time.perf_counter()
    made = overlay.dissolved(polygons)
    assert len(made) == 1 and time.perf_counter() - began < 30


def box(x, y, w, h):
    return np.array([(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)], float)


def test_rings_that_meet_in_corners():
    two = overlay.dissolved([[box(0, 0, 2, 2)], [box(2, 2, 2, 2)]])
    assert [len(p) for p in two] == [1, 1]
    # Two holes that meet in a corner, and one that meets the shell.
    holes = overlay.dissolved([[box(0, 0, 6, 6), box(1, 1, 2, 2), box(3, 3, 2, 2)]])
    assert len(holes) == 1 and len(holes[0]) == 3 and problem(rows_of(holes)) is None
    ring = overlay.dissolved([[box(0, 0, 3, 1)], [box(0, 2, 3, 1)], [box(0, 0, 1, 3)], [box(2, 1, 1, 2)]])
    assert len(ring) == 1 and len(ring[0]) == 2 and signed_area(ring[0][1]) == -1


def test_flat_and_repeated_shapes():
    line = np.array([(0, 0), (5, 5), (0, 0), (0, 0)], float)
    assert overlay.dissolved([[line]]) == []
    made = overlay.dissolved([[line], [box(0, 0, 2, 2)], [box(0, 0, 2, 2)], [box(0, 0, 2, 2)[::-1]]])
    assert len(made) == 1 and signed_area(made[0][0]) == 4


@pytest.mark.parametrize(("whole", "outline"), [(64, 1000), (1, 1000), (1, 0)])
@pytest.mark.parametrize("place", range(3))
def test_merged_equals_union(spark, monkeypatch, whole, outline, place):
    """Many slanted polygons; with clusters united at once, and all of them cut into cells with few pieces a task, whose
    outlines are stitched in a task or from chains."""
    monkeypatch.setattr(clean, "WHOLE", whole)
    monkeypatch.setattr(clean, "WHOLE_OUTLINE", outline)
    monkeypatch.setattr(clean, "CELL_PIECES", 512 if whole > 1 else 3)
    r = np.random.default_rng(place)
    origin, scale = PLACES[place]
    polygons = [[star(r, r.random(2) * 300, 12) * scale + origin] for _ in range(250)]
    polygons += [[box(350, 350, 9, 9) * scale + origin, box(351, 351, 3, 3)[::-1] * scale + origin]] * 2
    # crosses itself
    polygons += [[np.array([(400, 400), (402, 402), (402, 400), (400, 402), (400, 400)]) * scale + origin]]
    wanted = overlay.dissolved(polygons)
    rows = [(k, 1, rows_of([p])) for k, p in enumerate(polygons)] + [
        (900, 1, None), (901, 1, []), (902, 2, [rows_of([[box(0, 0, 1, 1)]])[0], rows_of([[box(1, 0, 1, 1)]])[0]])
    ]
    table = spark.createDataFrame(rows, f"poly_id bigint, scene_id bigint, parts {clean.PARTS}")
    got = clean.merged(table).collect()
    area = lambda rings: sum(
        signed_area((np.array([(p["x"], p["y"]) for p in ring]) - origin) / scale) * (1 if k == 0 else 1)
        for k, ring in enumerate(rings)
    )
    mine = sorted(abs(area(g["parts"][0])) for g in got if g["scene_id"] == 1)
    other = sorted(sum(signed_area((ring - origin) / scale) for ring in rings) for rings in wanted)
    assert len(mine) == len(other) and np.allclose(mine, other, atol=1e-4)
    assert [
        abs(signed_area(np.array([(p["x"], p["y"]) for p in g["parts"][0][0]]))) for g in got if g["scene_id"] == 2
    ] == [2.0]
    assert problems(pa.array([g["parts"] for g in got if g["scene_id"] == 2], nested.PARTS)) == [None]


def test_chains_are_ranked_into_circles(spark):
    r = np.random.default_rng(6)
    links, wanted = [], {}
    for size in (1, 2, 3, 64, 257):
        own = r.permutation(10**6)[:size] * 10 + size % 10
        lead = int(own.min())
        start = int(np.flatnonzero(own == lead)[0])
        for k in range(size):
            links.append((int(own[k]), int(own[(k + 1) % size])))
            wanted[int(own[k])] = (lead, (k - start) % size)
    rows = rings.ranked_circles(spark.createDataFrame(links, "id bigint, next bigint")).collect()
    assert {x["id"]: (x["ring"], x["place"]) for x in rows} == wanted
    assert rings.ranked_circles(spark.createDataFrame([], "id bigint, next bigint")).count() == 0


@pytest.mark.parametrize(
    "mask",
    [
        "111111111 100000001 101101101 101100001 100001111 111111000",
        "110110110 111111111 010101010 111111111 110110110",
        "101010101 111111111 100010001 111111111 101010101",
    ],
)
def test_regions_from_chains(spark, monkeypatch, mask):
    """Regions over many blocks, with holes that meet the shell or each other in corners."""
    pixels = [(s, y, x) for s in (1, 2) for y, row in enumerate(mask.split()) for x, c in enumerate(row) if c == "1"]
    found = polygonize.regions(spark.createDataFrame(pixels, "scene_id bigint, y bigint, x bigint"), 2)
    scenes = spark.createDataFrame(
        [(s, (10.0, 0.5, 0.0, 20.0, 0.0, -0.5)) for s in (1, 2)],
        "scene_id bigint, gt struct<x0:double,pw:double,rx:double,y0:double,ry:double,ph:double>",
    )
    whole = {r["poly_id"]: r for r in polygonize.polygons_of(found, scenes).collect()}
    monkeypatch.setattr(polygonize, "WHOLE_BOUNDARY", 0)
    monkeypatch.setattr(polygonize, "BLOCK", 2)
    chained = {r["poly_id"]: r for r in polygonize.polygons_of(found, scenes).collect()}
    shape = lambda r: (
        r["scene_id"],
        r["area"],
        r["first_y"],
        r["first_x"],
        sorted(tuple((p["x"], p["y"]) for p in ring) for ring in r["parts"][0]),
    )
    assert {k: shape(r) for k, r in whole.items()} == {k: shape(r) for k, r in chained.items()} and len(whole) >= 2


def test_merged_of_nothing(spark):
    empty = spark.createDataFrame([], f"poly_id bigint, scene_id bigint, parts {clean.PARTS}")
    assert clean.merged(empty).count() == 0
    lone = spark.createDataFrame([(1, 1, rows_of([[box(0.1, 0.2, 1, 1)]]))], empty.schema)
    assert clean.merged(lone).collect()[0]["parts"] == lone.collect()[0]["parts"]  # a part by itself stays as it is


@given(st.integers(1, 40), st.data())
@settings(max_examples=80, deadline=None)
def test_cells_keep_what_a_polygon_covers(cell, data):
    r = np.random.default_rng(data.draw(st.integers(0, 1 << 30)))
    shell = np.rint(star(r, (50, 50), 60)).astype(np.int64)
    e, _ = overlay.directed(shell, np.array([len(shell)]), np.array([True]))
    if len({tuple(p) for p in shell.tolist()}) < 3:
        return
    whole = overlay.outline(*overlay.noded(e, np.ones(len(e), np.int64)))
    total = 0
    for cx, cy, part in overlay.in_cells(e, cell):
        assert part[:, [0, 2]].min() >= cx * cell and part[:, [0, 2]].max() <= (cx + 1) * cell
        assert part[:, [1, 3]].min() >= cy * cell and part[:, [1, 3]].max() <= (cy + 1) * cell
        total += (part[:, 0] * part[:, 3] - part[:, 2] * part[:, 1]).sum()
    exact = (whole[:, 0] * whole[:, 3] - whole[:, 2] * whole[:, 1]).sum()
    cuts = len(range(-10, 110, cell)) * 2 * len(e)
    assert abs(total - exact) <= 2 * 60 * cuts  # half a step at each cut


def test_orientation_is_exact():
    r = np.random.default_rng(2)
    from fractions import Fraction

    a = r.random((400, 2)) * 1e6
    b = a + r.random((400, 2))
    t = r.integers(0, 1000, 400)[:, None] / 1000
    c = a + t * (b - a) + r.integers(-1, 2, (400, 2)) * 1e-10
    c[:50] = a[:50]
    for p, q, s, got in zip(a, b, c, orientation(a, b, c), strict=True):
        (px, py), (qx, qy), (sx, sy) = ([Fraction(float(v)) for v in x] for x in (p, q, s))
        value = (qx - px) * (sy - py) - (qy - py) * (sx - px)
        assert got == (value > 0) - (value < 0)


U = [(0, 0), (10, 0), (10, 10), (7, 10), (7, 3), (3, 3), (3, 10), (0, 10), (0, 0)]
IN_U = [(1, 1), (9, 1), (9, 9), (8, 9), (8, 2), (2, 2), (2, 9), (1, 9), (1, 1)]
CASES = {
    "a square": ([[box(0, 0, 4, 4)]], None),
    "a hole": ([[box(0, 0, 4, 4), box(1, 1, 1, 1)]], None),
    "a hole that sticks out a little": ([[box(0, 0, 4, 4), box(3, 1, 1.1, 1)]], "crossing"),
    "a hole that sticks out far": ([[box(0, 0, 4, 4), box(2, 1, 4, 1)]], "crossing"),
    "holes that overlap": ([[box(0, 0, 9, 9), box(1, 1, 3, 3), box(2, 2, 3, 3)]], "crossing"),
    "a hole in a hole": ([[box(0, 0, 9, 9), box(1, 1, 6, 6), box(2, 2, 1, 1)]], "holes overlap"),
    "a U in a U": ([[U, IN_U]], None),
    "a hole elsewhere": ([[box(0, 0, 4, 4), box(9, 9, 1, 1)]], "hole outside"),
    "a hole that touches the shell": ([[box(0, 0, 4, 4), [(0, 2), (1, 1), (1, 3), (0, 2)]]], None),
    "a hole along the shell": ([[box(0, 0, 4, 4), box(0, 1, 1, 1)]], "crossing"),
    "a hole through a corner": (
        [[[(0, 0), (4, 0), (4, 4), (2, 2), (0, 4), (0, 0)], [(2, 1), (3, 2), (2, 3), (1, 2), (2, 1)]]], "crossing"
    ),
    "a bow": ([[[(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)]]], "crossing"),
    "a spike": ([[[(0, 0), (4, 0), (4, 4), (4, 8), (4, 4), (0, 4), (0, 0)]]], "crossing"),
    "an hourglass": ([[[(0, 0), (4, 0), (2, 2), (4, 4), (0, 4), (2, 2), (0, 0)]]], "crossing"),
    "points twice": ([[[(0, 0), (0, 0), (4, 0), (4, 4), (4, 4), (0, 4), (0, 0)]]], None),
    "two parts": ([[box(0, 0, 1, 1)], [box(1, 1, 1, 1)]], None),
    "a part in a hole": ([[box(0, 0, 9, 9), box(1, 1, 5, 5)], [box(2, 2, 1, 1)]], None),
    "a part in a part": ([[box(0, 0, 9, 9)], [box(2, 2, 1, 1)]], "parts overlap"),
    "parts along each other": ([[box(0, 0, 2, 2)], [box(2, 0, 2, 2)]], "parts overlap"),
    "not a number": ([[[(0, 0), (float("nan"), 0), (1, 1), (0, 0)]]], "not finite"),
    "to and fro": ([[[(0, 0), (1, 0), (0, 0), (0, 0)]]], "short"),
}


@pytest.mark.parametrize("name", CASES)
def test_validity(name):
    polygon, wanted = CASES[name]
    assert problem(rows_of(polygon)) == wanted


def test_validity_of_many_at_once():
    names = list(CASES)
    together = pa.array([None, *(rows_of(CASES[n][0]) for n in names), [], [[]]], nested.PARTS)
    assert problems(together) == ["null", *(CASES[n][1] for n in names), "empty", "empty"]
    assert problems(together.slice(3, 5)) == [CASES[n][1] for n in names[2:7]]


def coast(r, n=400):
    """A crinkled ring, with holes near its shore."""
    a = np.arange(n) * 2 * np.pi / n
    q = 50 + 6 * np.sin(a * 17) + 3 * r.random(n)
    p = np.stack([q * np.cos(a), q * np.sin(a)], axis=1)
    rings = [np.concatenate([p, p[:1]])]
    for t in r.random(8) * 2 * np.pi:
        for far in (0.8, 0.9):
            h = star(r, (46 * far * np.cos(t), 46 * far * np.sin(t)), 1.5)[::-1]
            if problem(rows_of([[*rings, h]])) is None:
                rings.append(h)
    return rings


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("tolerance", [1.0, 5.0, 20.0])
def test_simplified_polygons_stay_valid(spark, seed, tolerance):
    r = np.random.default_rng(seed)
    rings = coast(r)
    assert problem(rows_of([rings])) is None
    points, ring = np.concatenate(rings), np.repeat(np.arange(len(rings)), [len(x) for x in rings])
    keep = simplified_together(points, ring, np.zeros(len(rings), np.int64), tolerance)
    made = [points[keep & (ring == k)] for k in range(len(rings))]
    assert problem(rows_of([made])) is None
    plain = [x[kept_points(x, tolerance)] for x in rings]
    if problem(rows_of([plain])) is None and tolerance == 1.0:
        assert sum(map(len, made)) <= sum(map(len, plain)) + 4
    assert sum(map(len, made)) < len(points) / 2


def test_a_shortcut_does_not_jump_over_a_hole():
    # A bay's mouth would be closed over an island, or the shell cut between a hole and its shore.
    shell = np.array([(0, 0), (10, 0), (10, 4), (5, 8), (0, 4), (0, 0)], float)
    hole = np.array([(5, 7.5), (5.2, 7), (4.8, 7), (5, 7.5)], float)
    points, ring = np.concatenate([shell, hole]), np.repeat([0, 1], [6, 4])
    keep = simplified_together(points, ring, np.zeros(2, np.int64), 100.0)
    made = [points[keep & (ring == k)] for k in range(2)]
    assert problem(rows_of([made])) is None


def test_simplify_and_smooth_keep_shapes_of_tables(spark):
    rows = [
        (1, None, "a"),
        (2, [], "b"),
        (3, [[]], "c"),
        (4, rows_of([[box(0, 0, 4, 4), box(1, 1, 1, 1)], [box(9, 9, 1, 1)]]), "d"),
    ]
    table = spark.createDataFrame(rows, f"poly_id bigint, parts {clean.PARTS}, points string")
    assert [r["poly_id"] for r in clean.simplify(table, 0.5).collect()] == [4]
    smooth = {r["poly_id"]: r["parts"] for r in clean.smooth(table, 2).collect()}
    assert smooth[1] is None and smooth[2] == [] and smooth[3] == [[]]
    assert [[len(r) for r in rings] for rings in smooth[4]] == [[17, 17], [17]]
    assert clean.smooth(table, 2).where(F.col("points") == "d").count() == 1


def test_edges_that_cross_within_one_square_settle():
    """The diagonals of a unit square lie half a step from each other's ends, and once took turns for ever."""
    e = np.array([[0, 0, 1, 1], [0, 1, 1, 0]], np.int64)
    made, _ = overlay.noded(e, np.ones(2, np.int64))
    assert not len(overlay.crossings(made)[0])
    assert {tuple(p) for p in made.reshape(-1, 2).tolist()} <= {(0, 0), (0, 1), (1, 0), (1, 1)}


def test_simplifying_is_shared_by_tasks(spark):
    """A table of one file, which one task reads, is simplified by several."""
    ring = [[(float(x), float(y)) for x, y in ((0, 0), (1, 0), (2, 0), (2, 2), (0, 2), (0, 0))]]
    rows = spark.createDataFrame([(k, [ring]) for k in range(64)], f"poly_id long, parts {clean.PARTS}").coalesce(1)
    made = clean.simplify(rows, 0.25).select(F.spark_partition_id().alias("task"), F.size(F.col("parts")[0][0]).alias("n"))
    found = made.collect()
    assert len({r["task"] for r in found}) > 1
    assert [r["n"] for r in found] == [5] * 64
