"""Cutting scenes into windows and burning polygons into masks.

Windows lie on a regular grid, so which of them cover a pixel, a run of pixels or a box is arithmetic: no spatial join
is needed. Polygons are burned once a scene, as runs of pixels, whatever the number of windows above them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segjobs.functions import nested
from segjobs.functions.shared import small
from segjobs.operators.blocks import arrays, parts_of, placed
from segjobs.operators.grid import clean_name, windows_along
from segjobs.operators.validate import bounds


def _along(first: Column, last: Column, n: Column, window: int, stride: int) -> Column:
    """The numbers of the windows that meet first..last, as an array."""
    low = F.greatest(F.floor((first - window) / stride) + 1, F.lit(0)).cast("long")
    high = F.least(F.floor(last / stride).cast("long"), n - 1)
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))


def _sized(scenes: DataFrame, window: int, stride: int) -> DataFrame:
    return scenes.select(
        "scene_id",
        "name",
        windows_along(F.col("width"), window, stride).alias("nx"),
        windows_along(F.col("height"), window, stride).alias("ny"),
    )


def in_windows(
    rows: DataFrame,
    scenes: DataFrame,
    window: int,
    stride: int,
    x0: str = "x",
    x1: str = "x",
    y0: str = "y",
    y1: str = "y",
) -> DataFrame:
    """Each row once for each window that meets its pixels x0..x1, y0..y1, with i, j, tile_idx and tile_name."""
    placed = rows.join(_sized(scenes, window, stride), "scene_id")
    placed = placed.withColumn("i", F.explode(_along(F.col(x0), F.col(x1), F.col("nx"), window, stride))).withColumn(
        "j", F.explode(_along(F.col(y0), F.col(y1), F.col("ny"), window, stride))
    )
    return placed.withColumn("tile_idx", F.col("i") * F.col("ny") + F.col("j") + 1).withColumn(
        "tile_name", F.format_string("%s_%05d", clean_name(F.col("name")), F.col("tile_idx"))
    ).drop("name", "nx", "ny")


def clip_pixels(pixels: DataFrame, scenes: DataFrame, window: int, stride: int) -> DataFrame:
    """The pixels of each window, with ty and tx inside it and all bands. A pixel is in every window that covers it."""
    out = in_windows(pixels, scenes, window, stride)
    return out.withColumns({"ty": F.col("y") - F.col("j") * stride, "tx": F.col("x") - F.col("i") * stride}).drop(
        "i", "j"
    )


def tiles_of(clipped: DataFrame, window: int, bands: list[str], nodata: float | None = None) -> DataFrame:
    """Block layout: scene_id, tile_idx, tile_name, size and bands, each a row-major array. One shuffle by tile.

    A pixel lies at its own place: one that is missing is null, or nodata, and two rows of one pixel are an error.
    """
    at = (F.col("ty") * window + F.col("tx")).cast("int")
    grouped = clipped.groupBy("scene_id", "tile_idx", "tile_name").agg(
        F.collect_list(F.struct(at.alias("p"), *[F.col(b).cast("double").alias(b) for b in bands])).alias("v")
    )

    def rows(batches):
        for whole in batches:
            for batch in parts_of(whole, window * window * len(bands)):
                size = pa.array(np.full(batch.num_rows, window, np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(k) for k in range(3)),
                        size,
                        arrays(*placed(batch.column(3), window * window, nodata)),
                    ],
                    ["scene_id", "tile_idx", "tile_name", "size", "bands"],
                )

    kept = grouped.select(
        F.col("scene_id").cast("long").alias("scene_id"),
        F.col("tile_idx").cast("long").alias("tile_idx"),
        "tile_name",
        "v",
    )
    return kept.mapInArrow(
        rows, "scene_id bigint, tile_idx bigint, tile_name string, size int, bands array<array<double>>"
    )


def pixels_of(tiles: DataFrame, bands: list[str], keys: tuple[str, ...] = ("tile_name",)) -> DataFrame:
    """Long layout of tiles: keys, y, x and a column for each band; the inverse of tiles_of."""
    zipped = F.arrays_zip(*[F.col("bands")[k].alias(b) for k, b in enumerate(bands)])
    rows = tiles.select(*keys, "size", F.posexplode(zipped).alias("p", "v"))
    return rows.select(
        *keys,
        F.floor(F.col("p") / F.col("size")).alias("y"),
        (F.col("p") % F.col("size")).cast("long").alias("x"),
        *[F.col("v")[b].alias(b) for b in bands],
    )


def candidates(polygons: DataFrame, scenes: DataFrame, window: int, stride: int) -> DataFrame:
    """(poly_id, scene_id, tile_idx, tile_name) of polygons whose box meets a window; touching counts."""
    own = bounds(polygons).join(scenes.select("scene_id", "gt"), "scene_id")
    px = {
        "bx0": (F.col("min_x") - F.col("gt.x0")) / F.col("gt.pw"),
        "bx1": (F.col("max_x") - F.col("gt.x0")) / F.col("gt.pw"),
        "by0": (F.col("gt.y0") - F.col("max_y")) / F.col("gt.pw"),
        "by1": (F.col("gt.y0") - F.col("min_y")) / F.col("gt.pw"),
    }
    own = own.withColumns(px).select(
        "poly_id",
        "scene_id",
        (F.ceil("bx0") - 1).alias("bx0"),
        F.floor("bx1").alias("bx1"),
        (F.ceil("by0") - 1).alias("by0"),
        F.floor("by1").alias("by1"),
    )
    return in_windows(own, scenes, window, stride, "bx0", "bx1", "by0", "by1").select(
        "poly_id", "scene_id", "tile_idx", "tile_name"
    )


def burned(e: np.ndarray, part: np.ndarray, width: np.ndarray, height: np.ndarray) -> list[np.ndarray]:
    """(part, y, first x, last x) of the runs of pixels whose centre is inside a part, in arrays. e: edges (n x 4) of
    closed rings in pixels, y downwards; part: of each edge; width and height: of each part's scene.

    Inside is decided by the parity of crossings in each row. A centre on an edge belongs to the side towards larger x
    and y.
    """
    level = e[:, 1] == e[:, 3]
    e, part = e[~level], part[~level]
    low, high = np.minimum(e[:, 1], e[:, 3]), np.maximum(e[:, 1], e[:, 3])
    first = np.maximum(np.ceil(low - 0.5), 0).astype(np.int64)
    last = np.minimum(np.ceil(high - 0.5) - 1, height[part] - 1).astype(np.int64)
    n = np.maximum(last - first + 1, 0)
    which = np.repeat(np.arange(len(e)), n)
    row = first[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    f, own = e[which], part[which]
    at = f[:, 0] + (row + 0.5 - f[:, 1]) * (f[:, 2] - f[:, 0]) / (f[:, 3] - f[:, 1])
    order = np.lexsort((at, row, own))
    row, at, own = row[order][0::2], at[order], own[order][0::2]
    # Crossings of a part's row come in pairs: in and out.
    start = np.maximum(np.ceil(at[0::2] - 0.5), 0).astype(np.int64)
    stop = np.minimum(np.ceil(at[1::2] - 0.5) - 1, width[own] - 1).astype(np.int64)
    some = start <= stop
    return [own[some], row[some], start[some], stop[some]]


def burned_runs(polygons: DataFrame, scenes: DataFrame) -> DataFrame:
    """scene_id, poly_id, y, x0, x1: the runs of pixels that each polygon covers; those of parts that overlap do too.

    Whole batches of polygons at a time. Null polygons, and rings of under two points, cover nothing.
    """
    gt = [F.col(f"gt.{c}").alias(c) for c in ("x0", "y0", "pw")]
    own = polygons.where("parts IS NOT NULL").join(scenes.select("scene_id", *gt, "width", "height"), "scene_id")

    def rows(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                batch = whole.slice(i, 1024)
                scene, poly, x0, y0, pixel, width, height = (
                    batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 3, 4, 5, 6, 7)
                )
                parts = batch.column(2)
                rings = parts.flatten()
                points = rings.flatten()
                of_part = np.repeat(np.arange(batch.num_rows), nested.sizes(parts))
                part = np.repeat(np.arange(len(of_part)), nested.sizes(rings))
                ring = np.repeat(np.arange(len(part)), nested.sizes(points))
                xy, at = nested.flat_points(points.flatten()), of_part[part[ring]]
                px = np.stack([(xy[:, 0] - x0[at]) / pixel[at], (y0[at] - xy[:, 1]) / pixel[at]], axis=1)
                same = ring[1:] == ring[:-1]
                e, owner = np.concatenate([px[:-1], px[1:]], axis=1)[same], part[ring[1:]][same]
                own_part, y, first, last = burned(e, owner, width[of_part], height[of_part])
                k = of_part[own_part]
                columns = [scene[k], poly[k], y, first, last]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in columns], ["scene_id", "poly_id", "y", "x0", "x1"]
                )

    places = ["scene_id", F.col("poly_id").cast("long").alias("poly_id"), "parts", "x0", "y0", "pw", "width", "height"]
    return own.select(*places).mapInArrow(rows, "scene_id bigint, poly_id bigint, y bigint, x0 bigint, x1 bigint")


def burn_rows(
    parts: list, x0: float, y0: float, pixel: float, width: int, height: int
) -> list[tuple[int, int, int]]:
    """Runs (y, first x, last x) of one polygon, part by part."""
    edges, owner = [np.empty((0, 4))], [np.empty(0, np.int64)]
    for k, ring in ((k, ring) for k, rings in enumerate(parts) for ring in rings):
        p = np.array([((v["x"] - x0) / pixel, (y0 - v["y"]) / pixel) for v in ring], np.float64).reshape(-1, 2)
        edges.append(np.concatenate([p[:-1], p[1:]], axis=1))
        owner.append(np.full(max(len(p) - 1, 0), k))
    size = np.full(len(parts), width), np.full(len(parts), height)
    _, y, first, last = burned(np.concatenate(edges), np.concatenate(owner), *size)
    return list(zip(y.tolist(), first.tolist(), last.tolist(), strict=True))


def burned_pixels(runs: DataFrame) -> DataFrame:
    """scene_id, y, x of the pixels that any polygon covers."""
    return runs.select("scene_id", "y", F.explode(F.sequence("x0", "x1")).alias("x")).distinct()


def kept_tiles(runs: DataFrame, scenes: DataFrame, window: int, stride: int) -> DataFrame:
    """scene_id, tile_idx, tile_name of windows with a covered pixel: from runs, so before any pixel is copied."""
    return in_windows(runs.select("scene_id", "y", "x0", "x1"), scenes, window, stride, "x0", "x1").select(
        "scene_id", "tile_idx", "tile_name"
    ).distinct()


def tile_masks(runs: DataFrame, scenes: DataFrame, window: int, stride: int, burn: int = 255) -> DataFrame:
    """scene_id, tile_idx, tile_name, mask (row-major) of windows with a covered pixel; ``burn`` where covered, else 0.

    Runs, not pixels, go to the windows that they meet; one shuffle by window. A mask is filled by running sums over
    where runs begin and end, so its time grows with its pixels and runs alone.
    """
    if not 1 <= burn <= 255:
        raise ValueError(f"burn value {burn} is not within 1 and 255")
    placed = in_windows(runs.select("scene_id", "y", "x0", "x1").distinct(), scenes, window, stride, "x0", "x1")
    ty, tx = F.col("y") - F.col("j") * stride, lambda c: F.col(c) - F.col("i") * stride
    begin, end = F.greatest(tx("x0"), F.lit(0)), F.least(tx("x1"), F.lit(window - 1)) + 1
    line = ty * (window + 1)  # a row has one place more, where runs up to its end stop
    placed = placed.select(
        "scene_id",
        "tile_idx",
        "tile_name",
        (line + begin).cast("int").alias("begin"),
        (line + end).cast("int").alias("end"),
    )
    grouped = placed.groupBy("scene_id", "tile_idx", "tile_name").agg(
        F.collect_list("begin").alias("begin"), F.collect_list("end").alias("end")
    )
    size = window * (window + 1)
    few = max(1, (1 << 20) // size)  # tiles filled at a time, by memory

    def rows(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, few):
                part = batch.slice(i, few)
                n = part.num_rows
                steps = np.zeros(n * size, np.int32)
                for name, by in (("begin", 1), ("end", -1)):
                    lists = part.column(part.schema.get_field_index(name))
                    of = np.repeat(np.arange(n) * size, lists.value_lengths().to_numpy(zero_copy_only=False))
                    np.add.at(steps, of + lists.flatten().to_numpy(zero_copy_only=False), by)
                on = np.cumsum(steps.reshape(n * window, window + 1), axis=1)[:, :window] > 0
                offsets = pa.array(np.arange(n + 1, dtype=np.int32) * (window * window))
                mask = pa.ListArray.from_arrays(offsets, pa.array(np.where(on, burn, 0).astype(np.int16).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in range(3)), mask], ["scene_id", "tile_idx", "tile_name", "mask"]
                )

    return grouped.mapInArrow(rows, "scene_id bigint, tile_idx bigint, tile_name string, mask array<smallint>")


def wanted_pixels(pixels: DataFrame, kept: DataFrame, window: int, stride: int) -> DataFrame:
    """The pixels that any of the kept windows (scene_id, tile_idx, i, j) covers, before they are copied to windows.

    Pixels and windows meet over blocks of the stride: a semi-join, broadcast below a checked size.
    """
    across = -(-window // stride)
    over = lambda c: F.explode(F.sequence(F.col(c), F.col(c) + (across - 1)))
    blocks = kept.select("scene_id", over("i").alias("bx"), "j").select(
        "scene_id", "bx", over("j").alias("by")
    ).distinct()
    keyed = pixels.withColumns({"bx": F.floor(F.col("x") / stride), "by": F.floor(F.col("y") / stride)})
    return keyed.join(small(blocks), ["scene_id", "bx", "by"], "left_semi").drop("bx", "by")


def clip_counts(scenes: DataFrame, kept: DataFrame, window: int, stride: int) -> DataFrame:
    """scene_id, tile_count (kept) and skipped_count."""
    n = kept.groupBy("scene_id").agg(F.count("*").alias("tile_count"))
    own = _sized(scenes, window, stride).join(n, "scene_id", "left").withColumn(
        "tile_count", F.coalesce("tile_count", F.lit(0).cast("long"))
    )
    return own.select(
        "scene_id", "tile_count", (F.col("nx") * F.col("ny") - F.col("tile_count")).alias("skipped_count")
    )
