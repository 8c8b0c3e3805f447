"""Checks of scenes and polygons. Each returns the rows that violate it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segjobs.functions import nested
from segjobs.functions.segments import CROSS, contacts, sides

TILE_SIZES = (64, 128, 256, 512, 1024)
MAX_BANDS = 40


def wrong_types(polygons: DataFrame) -> DataFrame:
    return polygons.where(~F.col("geom_type").isin("Polygon", "MultiPolygon")).groupBy("geom_type").agg(
        F.count("*").alias("n")
    )


def scenes_without_polygons(scenes: DataFrame, polygons: DataFrame) -> DataFrame:
    return scenes.join(polygons.select("scene_id").distinct(), "scene_id", "left_anti")


def crs_mismatches(scenes: DataFrame, polygons: DataFrame) -> DataFrame:
    """poly_id, scene_id, crs and scene_crs where they differ."""
    own = scenes.select("scene_id", F.col("crs").alias("scene_crs"))
    return polygons.join(own, "scene_id").where("crs <> scene_crs").select("poly_id", "scene_id", "crs", "scene_crs")


def bounds(polygons: DataFrame) -> DataFrame:
    """polygons with min_x, min_y, max_x, max_y over all vertices."""
    points = F.flatten(F.flatten("parts"))
    return polygons.withColumns(
        {
            "min_x": F.array_min(F.transform(points, lambda p: p["x"])),
            "min_y": F.array_min(F.transform(points, lambda p: p["y"])),
            "max_x": F.array_max(F.transform(points, lambda p: p["x"])),
            "max_y": F.array_max(F.transform(points, lambda p: p["y"])),
        }
    )


def scene_bounds(scenes: DataFrame) -> DataFrame:
    """scene_id, west, south, east, north."""
    return scenes.select(
        "scene_id",
        F.col("gt.x0").alias("west"),
        (F.col("gt.y0") + F.col("height") * F.col("gt.ph")).alias("south"),
        (F.col("gt.x0") + F.col("width") * F.col("gt.pw")).alias("east"),
        F.col("gt.y0").alias("north"),
    )


def without_overlap(scenes: DataFrame, polygons: DataFrame) -> DataFrame:
    """Scenes whose polygons' joint extent does not meet their own."""
    extent = bounds(polygons).groupBy("scene_id").agg(
        F.min("min_x").alias("x0"), F.min("min_y").alias("y0"), F.max("max_x").alias("x1"), F.max("max_y").alias("y1")
    )
    return scene_bounds(scenes).join(extent, "scene_id").where(
        "x1 < west OR x0 > east OR y1 < south OR y0 > north"
    ).select("scene_id")


def uneven_pixels(scenes: DataFrame) -> DataFrame:
    """Scenes whose pixels are not square, or turned."""
    square = (F.abs("gt.pw") == F.abs("gt.ph")) & (F.coalesce("gt.rx", F.lit(0.0)) == 0) & (
        F.coalesce("gt.ry", F.lit(0.0)) == 0
    )
    return scenes.where(~square).select("scene_id")


def _first(found: list[str | None], rows: np.ndarray, what: str) -> None:
    for k in np.unique(rows).tolist():
        found[k] = found[k] or what


def problems(parts: pa.Array) -> list[str | None]:
    """What is wrong with each polygon of a list array of parts: null, empty, short (a ring of under four points), open,
    not finite, crossing (rings that meet other than at points, or themselves anywhere), hole outside, holes overlap or
    parts overlap; None if nothing. Points that repeat their predecessor do not matter. The segments of all polygons of
    an array are indexed together; every test is exact.
    """
    found: list[str | None] = [None if v else "null" for v in parts.is_valid().to_pylist()]
    n_parts = nested.sizes(parts)
    flat = parts.flatten()
    n_rings = nested.sizes(flat)
    row_of_part = np.repeat(np.arange(len(parts)), n_parts)
    for k in np.flatnonzero(np.bincount(row_of_part, n_rings, len(parts)) == 0).tolist():
        found[k] = found[k] or "empty"
    rings = flat.flatten()
    size = nested.sizes(rings)
    part = np.repeat(np.arange(len(flat)), n_rings)
    row = row_of_part[part]
    shell = np.arange(len(part)) == np.repeat(np.cumsum(n_rings) - n_rings, n_rings)
    _first(found, row[size < 4], "short")
    xy = nested.flat_points(rings.flatten())
    ring = np.repeat(np.arange(len(size)), size)
    _first(found, row[ring[~np.isfinite(xy).all(axis=1)]], "not finite")
    begin = np.cumsum(size) - size
    some = np.flatnonzero(size > 0)
    _first(found, row[some[(xy[begin[some]] != xy[begin[some] + size[some] - 1]).any(axis=1)]], "open")
    good = np.array([f is None for f in found], bool)
    inner = np.flatnonzero((ring[1:] == ring[:-1]) & (xy[1:] != xy[:-1]).any(axis=1) & good[row[ring[1:]]]) if len(
        ring
    ) else np.empty(0, np.int64)
    e, ring = np.concatenate([xy[inner], xy[inner + 1]], axis=1), ring[inner + 1] if len(inner) else ring[:0]
    if not len(e):
        _first(found, row[good[row]], "short")
        return found
    edges_in = np.bincount(ring, minlength=len(size))
    _first(found, row[(edges_in < 3) & good[row]], "short")  # all its points are one or two
    first = np.cumsum(edges_in) - edges_in
    at = np.arange(len(e)) - first[ring]
    owner = row[ring]
    for i, j, kind in contacts(e, owner):
        same, gap = ring[i] == ring[j], np.abs(at[i] - at[j])
        neighbours = same & ((gap == 1) | (gap == edges_in[ring[i]] - 1))
        own_part = part[ring[i]] == part[ring[j]]
        wrong = np.where(same & ~neighbours, True, kind == CROSS)
        _first(found, owner[i[wrong & own_part]], "crossing")
        _first(found, owner[i[wrong & ~own_part]], "parts overlap")
    _nesting(found, e, ring, row, part, shell)
    return found


def _nesting(
    found: list[str | None], e: np.ndarray, ring: np.ndarray, row: np.ndarray, part: np.ndarray, shell: np.ndarray
) -> None:
    """Whether holes lie in their shell and in no other hole, and parts in no other part: by their points that no other
    ring holds."""
    owner = row[ring]
    several = np.bincount(row, minlength=len(found))[owner] > 1
    good = np.array([f is None for f in found], bool)
    e, ring = e[several & good[owner]], ring[several & good[owner]]
    if not len(e):
        return
    odd: dict[tuple[int, int], int] = {}
    held: set[tuple[int, int]] = set()
    for p, k, on in sides(e[:, :2], row[ring], e, row[ring]):
        other = ring[p] != ring[k]
        p, k, on = p[other], k[other], on[other]
        held.update(zip(p[on].tolist(), ring[k[on]].tolist(), strict=True))
        both, times = np.unique(np.stack([p[~on], ring[k[~on]]]), axis=1, return_counts=True)
        for a, b, c in zip(*both.tolist(), times.tolist(), strict=True):
            odd[a, b] = odd.get((a, b), 0) + c
    inside = {pair for pair, c in odd.items() if c % 2} - held
    shells = {int(part[r]): int(r) for r in np.unique(ring).tolist() if shell[r]}
    free: dict[int, list[int]] = {}
    for p, r in enumerate(ring.tolist()):
        free.setdefault(r, []).append(p)
    for r, own in free.items():
        if not shell[r]:
            s = shells[int(part[r])]
            loose = [p for p in own if (p, s) not in held]
            here = sum((p, s) in inside for p in loose)
            if here < len(loose) or not loose:
                _first(found, row[[r]], "hole outside" if not here else "crossing")
    by_point: dict[int, list[int]] = {}
    for p, r in inside:
        by_point.setdefault(p, []).append(r)
    for p, around in by_point.items():
        r = int(ring[p])
        if not shell[r] and any(not shell[q] and part[q] == part[r] for q in around):
            _first(found, row[[r]], "holes overlap")
        elif shell[r]:
            depth: dict[int, int] = {}
            for q in around:
                depth[int(part[q])] = depth.get(int(part[q]), 0) + 1
            if any(c % 2 and q != int(part[r]) for q, c in depth.items()):
                _first(found, row[[r]], "parts overlap")


_PARTS_TYPE = pa.list_(nested.RINGS)


def problem(parts: list | None) -> str | None:
    """What is wrong with one polygon, as problems() has it."""
    return problems(pa.array([parts], _PARTS_TYPE))[0]


def invalid(polygons: DataFrame) -> DataFrame:
    """poly_id, scene_id and problem of null, empty and invalid polygons; a warning, since they are burned all the
    same."""

    def rows(batches):
        for batch in batches:
            found = pa.array(problems(batch.column(2)), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), found], ["poly_id", "scene_id", "problem"]
            ).filter(found.is_valid())

    return polygons.select(F.col("poly_id").cast("long"), F.col("scene_id").cast("long"), "parts").mapInArrow(
        rows, "poly_id bigint, scene_id bigint, problem string"
    )


def check_percentages(train: int, valid: int, test: int) -> None:
    if min(train, valid, test) < 0 or train + valid + test != 100:
        raise ValueError(f"percentages must add up to 100: {train}, {valid}, {test}")


def unfit_runs(runs: DataFrame, tiles: DataFrame) -> DataFrame:
    """run_id and problem of planned splits (run_id, version, train, valid, test) that cannot run: no version,
    percentages (negative, missing, or not 100 together), or no tiles (rows of tiles) of the version."""
    fit = F.coalesce(F.expr("train >= 0 AND valid >= 0 AND test >= 0 AND train + valid + test = 100"), F.lit(False))
    there = tiles.select("version").distinct().withColumn("_there", F.lit(True))
    what = F.when(F.col("version").isNull(), "no version").when(~fit, "percentages").when(
        F.col("_there").isNull(), "no tiles"
    )
    return runs.join(there, "version", "left").select("run_id", what.alias("problem")).where("problem IS NOT NULL")


def check_not_empty(df: DataFrame, what: str) -> None:
    if df.isEmpty():
        raise ValueError(f"there are no {what}")


def unfit_scenes(scenes: DataFrame, bands: int, tile_size: int, sizes: tuple[int, ...] = TILE_SIZES) -> DataFrame:
    """scene_id and what keeps a scorer for so many bands from it; all scenes if the tile size is not supported."""
    what = F.when(F.lit(tile_size not in sizes), "tile size").when(
        ~F.col("band_count").between(1, MAX_BANDS), "band count"
    ).when(F.col("band_count") != bands, "bands differ")
    return scenes.select("scene_id", what.alias("problem")).where("problem IS NOT NULL")


def scene_summary(scenes: DataFrame) -> DataFrame:
    return scenes.select("scene_id", "width", "height", "band_count", "crs", F.abs("gt.pw").alias("pixel_size"))
