"""Every registered raster query with SQL has the rows that DuckDB finds."""

import itertools
import math
import os

import duckdb
import numpy as np
import pytest

import __spark_entry__
from segjobs.functions.geometry import simplified_together
from segjobs.operators import clean, jobs, validate
from segjobs.plans import catalogue

QUICK = sorted(catalogue.SQL)


@pytest.fixture(scope="module")
def database(sf_dir):
    with duckdb.connect() as connection:
        for f in os.listdir(sf_dir):
            connection.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
        yield connection


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, sf_dir, database, name, tmp_path):
    __spark_entry__.queries()[name](spark, sf_dir).write.parquet(f"{tmp_path}/out")
    columns = ", ".join(
        f'"{c[0]}"' for c in database.execute(f"DESCRIBE SELECT * FROM '{tmp_path}/out/*.parquet'").fetchall()
    )
    own, sql = f"SELECT {columns} FROM '{tmp_path}/out/*.parquet'", f"SELECT {columns} FROM ({catalogue.SQL[name]})"
    for a, b in ((own, sql), (sql, own)):
        assert database.execute(f"SELECT count(*) FROM ({a} EXCEPT ALL {b})").fetchall() == [(0,)]


def test_display_shows_tiles_with_nan(spark, sf_dir, database):
    """All tiles, by the SQL without its filter of those with a NaN."""
    wanted = dict(database.execute(catalogue.SQL["m7_display"].replace(" WHERE vec_id % 43 <> 0", "")).fetchall())
    odd = {
        r["tile_name"] for r in catalogue.fx.images(spark, sf_dir).where("exists(bands[0], v -> isnan(v))").collect()
    }
    assert odd and odd <= set(wanted)
    assert {
        r["tile_name"]: r["total"] for r in __spark_entry__.queries()["m7_display"](spark, sf_dir).collect()
    } == wanted


def test_custom_scorer_scores_padded_tiles(spark, sf_dir):
    """Every tile of every scene, by brute force: the padding is scaled along with its band and counts as pixels."""
    scenes, pixels = catalogue.fx.scenes(spark, sf_dir).toPandas(), catalogue.fx.pixels(spark, sf_dir).toPandas()
    wanted = {}
    for scene, width, height in scenes[["scene_id", "width", "height"]].itertuples(index=False):
        own = pixels[pixels["scene_id"] == scene]
        image = np.full((3, height, width), np.nan)
        image[:, own["y"], own["x"]] = own[["b1", "b2", "b3"]].to_numpy(float).T
        for row, col in itertools.product(range(0, height, 8), range(0, width, 8)):
            read = image[:, row : row + 16, col : col + 16]
            tile = np.zeros((3, 16, 16))
            tile[:, : read.shape[1], : read.shape[2]] = read
            low, high = read.min((1, 2))[:, None, None], read.max((1, 2))[:, None, None]
            tile = np.where(high > low, (tile - low) / np.where(high > low, high - low, 1), 0)
            z = np.tensordot([2.0, -1.0, 0.5], tile, 1) - 0.25
            wanted[scene, col, row] = (1 / (1 + np.exp(-z))).sum() * 1000
    got = {
        (r["scene_id"], r["col0"], r["row0"]): r["total"]
        for r in __spark_entry__.queries()["s2_custom_scorer"](spark, sf_dir).collect()
    }
    assert wanted and set(got) == set(wanted)
    assert all(abs(got[k] - v) <= 0.501 for k, v in wanted.items())


def plain_area(ring):
    return abs(sum(a[0] * b[1] - a[1] * b[0] for a, b in itertools.pairwise(ring))) / 2


def plainly_simplified(ring, tolerance):
    """Douglas-Peucker by recursion, from the first point and the one farthest from it."""
    if len(ring) <= 4:
        return ring
    square = [(x - ring[0][0]) ** 2 + (y - ring[0][1]) ** 2 for x, y in ring]
    far = square.index(max(square))
    kept, dropped = {0, far, len(ring) - 1}, []

    def part(a, b):
        if b - a < 2:
            return
        (ax, ay), dx, dy = ring[a], ring[b][0] - ring[a][0], ring[b][1] - ring[a][1]
        away = []
        for x, y in ring[a + 1 : b]:
            t = min(max(((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy), 0), 1) if dx or dy else 0
            away.append(math.sqrt((x - ax - t * dx) ** 2 + (y - ay - t * dy) ** 2))
        k = a + 1 + away.index(max(away))
        if max(away) <= tolerance:
            dropped.append((max(away), k))
            return
        kept.add(k)
        part(a, k)
        part(k, b)

    part(0, far)
    part(far, len(ring) - 1)
    for _, k in sorted(dropped, reverse=True):
        if len(kept) < 4:
            kept.add(k)
    return [ring[k] for k in sorted(kept)] if len(kept) >= 4 else ring


def plainly_smoothed(ring):
    corners = [
        ((3 * a[0] + b[0]) / 4, (3 * a[1] + b[1]) / 4, (a[0] + 3 * b[0]) / 4, (a[1] + 3 * b[1]) / 4)
        for a, b in itertools.pairwise(ring)
    ]
    points = [p for c in corners for p in (c[:2], c[2:])]
    return [*points, points[0]]


def plainly_cleaned(parts, min_hole, low, high, tolerance):
    """The area of one polygon after the steps, one after another, or None if a filter leaves it out."""
    parts = [[[(p["x"], p["y"]) for p in ring] for ring in rings] for rings in parts]
    parts = [
        [rings[0], *[r for r in rings[1:] if min_hole > 0 and plain_area(r) >= min_hole]] for rings in parts if rings
    ]
    area = lambda: sum(plain_area(rings[0]) - sum(map(plain_area, rings[1:])) for rings in parts)
    if not low <= area() <= high:
        return None
    made = [[plainly_simplified(r, tolerance) for r in rings] for rings in parts]
    as_rows = lambda some: [[[{"x": x, "y": y} for x, y in r] for r in rings] for rings in some]
    # some shortcuts are taken back
    if validate.problem(as_rows(parts)) is None and validate.problem(as_rows(made)) is not None:
        rings = [np.array(r) for own in parts for r in own]
        points, ring = np.concatenate(rings), np.repeat(np.arange(len(rings)), [len(r) for r in rings])
        keep = simplified_together(points, ring, np.zeros(len(rings), np.int64), tolerance)
        left = iter([points[keep & (ring == k)].tolist() for k in range(len(rings))])
        made = [[next(left) for _ in own] for own in parts]
        assert validate.problem(as_rows(made)) is None
    parts = made
    parts = [[plainly_smoothed(r) for r in rings] for rings in parts]
    return area()


def test_clean_up_equals_plain_steps(spark, sf_dir):
    """The queries with simplifying and smoothing, which have no SQL. What they start from has: pp1 and s5 compare
    it."""
    regions = jobs.predict_polygons(catalogue._prediction(spark, sf_dir), catalogue.fx.scenes(spark, sf_dir))
    merged = clean.merged(catalogue.fx.predicted_polygons(spark, sf_dir))
    cases = {
        "pp7_pp8_clean_up": (merged, 0, 10, 400, 0.5), "j6_j7_predict_and_clean": (regions, 1.0, 1.0, math.inf, 0.25)
    }
    for name, (polygons, *steps) in cases.items():
        wanted = {}
        for r in polygons.select("scene_id", "parts").collect():
            area = plainly_cleaned(r["parts"], *steps)
            if area is not None:
                wanted.setdefault(r["scene_id"], []).append(area)
        got = {r[0]: r[1:] for r in __spark_entry__.queries()[name](spark, sf_dir).collect()}
        assert wanted and {k: n for k, (n, _) in got.items()} == {k: len(v) for k, v in wanted.items()}, name
        assert all(abs(got[k][1] - 1000 * sum(v)) <= 1 for k, v in wanted.items()), name


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() >= 1


def test_names():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
