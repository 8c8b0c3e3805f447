"""Clean-up of polygons: merge, fill holes, area filters, simplify, smooth; in this order, each step optional."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segjobs.functions import nested
from segjobs.functions.geometry import chaikin, simplified_together
from segjobs.functions.graph import components
from segjobs.functions.overlay import BITS, cancelled, directed, in_cells, polygons_of, united
from segjobs.functions.shared import discard, small, stored
from segjobs.operators import rings
from segjobs.operators.validate import bounds, check_not_empty, problems

PARTS = "array<array<array<struct<x:double,y:double>>>>"


def ring_area(ring: Column) -> Column:
    """The area of a closed ring, by the shoelace formula."""
    step = lambda a, i: a + ring[i]["x"] * ring[i + 1]["y"] - ring[i + 1]["x"] * ring[i]["y"]
    return F.when(F.size(ring) < 4, 0.0).otherwise(
        F.abs(F.aggregate(F.sequence(F.lit(0), F.size(ring) - 2), F.lit(0.0), step)) / 2
    )


def area(parts: Column) -> Column:
    """Shells less holes, over all parts."""
    part = lambda rings: 2 * ring_area(rings[0]) - F.aggregate(
        rings, F.lit(0.0), lambda a, r: a + ring_area(r)
    )
    return F.aggregate(F.filter(parts, lambda rings: F.size(rings) > 0), F.lit(0.0), lambda a, rings: a + part(rings))


def usable(polygons: DataFrame) -> DataFrame:
    """Without null and empty geometries."""
    return polygons.where(F.col("parts").isNotNull() & F.exists("parts", lambda rings: F.size(rings) > 0))


#: Clusters of more parts are cut into cells; a cell's pieces are united by so many a task, and then what comes of them.
WHOLE, CELL_PIECES = 64, 512
#: Outlines of more edges are put together from chains, and by no single task.
WHOLE_OUTLINE = 200_000
#: A cluster's cells are no smaller than this share of its extent.
CELLS_ALONG = 512

_MERGED = "scene_id bigint, rings array<array<struct<x:double,y:double>>>"


def boxed(polygons: DataFrame) -> DataFrame:
    """scene_id, part_id, rings and box of the parts of polygons; copies within a scene once, parts with a coordinate
    that is null or not finite never."""
    parts = usable(polygons).select(
        F.col("scene_id").cast("long").alias("scene_id"), F.explode("parts").alias("rings")
    ).where(F.size("rings") > 0)
    known = bounds(parts.dropDuplicates(["scene_id", "rings"]).withColumn("parts", F.array("rings"))).drop("parts")
    fine = F.forall(F.flatten("rings"), lambda p: (F.abs(p["x"]) < float("inf")) & (F.abs(p["y"]) < float("inf")))
    return stored(known.where(fine).withColumn("part_id", F.monotonically_increasing_id()))


def gridded(parts: DataFrame) -> DataFrame:
    """scene_id, grid, ox, oy: the grid step, a power of two by which a scene's coordinates have BITS bits, and its
    origin in steps."""
    extent = F.greatest(F.max("max_x") - F.min("min_x"), F.max("max_y") - F.min("min_y"), F.lit(1e-300))
    step = F.pow(F.lit(2.0), F.ceil(F.log2(extent)) - BITS)
    found = parts.groupBy("scene_id").agg(step.alias("grid"), F.min("min_x").alias("x"), F.min("min_y").alias("y"))
    return found.select(
        "scene_id",
        "grid",
        F.floor(F.col("x") / F.col("grid")).cast("double").alias("ox"),
        F.floor(F.col("y") / F.col("grid")).cast("double").alias("oy"),
    )


def touching(parts: DataFrame) -> DataFrame:
    """Pairs (a, b) of parts (from boxed()) of a scene whose boxes touch, each once.

    Cells follow the parts: a part lies in the at most four cells, twice as wide as it at most, of the level of its own
    size, and looks for others of its level and of every wider one that its scene has. So neither a town of small parts
    in an empty land nor a part over all of them fills a cell with parts that do not touch.
    """
    side = F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"))
    # Wide enough that whole numbers of cells stay exact, however far from the origin.
    far = F.greatest(*[F.abs(c) for c in ("min_x", "max_x", "min_y", "max_y")])
    own = parts.select(
        "scene_id",
        "part_id",
        "min_x",
        "min_y",
        "max_x",
        "max_y",
        F.ceil(F.log2(F.greatest(side, far / float(1 << 50), F.lit(1e-300)))).cast("int").alias("level"),
    )
    levels = own.groupBy("scene_id").agg(F.collect_set("level").alias("levels"))
    cell = lambda c, level: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col(level))).cast("long")
    along = lambda low, high, level: F.explode(F.sequence(cell(low, level), cell(high, level)))

    def placed(rows: DataFrame, prefix: str) -> DataFrame:
        rows = rows.withColumn("cx", along("min_x", "max_x", "at")).withColumn("cy", along("min_y", "max_y", "at"))
        return rows.select(
            "scene_id",
            "at",
            "cx",
            "cy",
            *[F.col(c).alias(f"{prefix}_{c}") for c in ("part_id", "min_x", "min_y", "max_x", "max_y", "level")],
        )

    looking = own.join(small(stored(levels)), "scene_id").withColumn(
        "at", F.explode(F.filter("levels", lambda x: x >= F.col("level")))
    ).drop("levels")
    a, b = placed(looking, "a"), placed(own.withColumn("at", F.col("level")), "b")
    meet = "(a_level < b_level OR a_part_id < b_part_id) AND a_min_x <= b_max_x AND b_min_x <= a_max_x AND a_min_y <= b_max_y AND b_min_y <= a_max_y"
    corner = lambda axis: F.floor(
        F.greatest(f"a_min_{axis}", f"b_min_{axis}") / F.pow(F.lit(2.0), F.col("at"))
    ).cast("long")
    found = a.join(b, ["scene_id", "at", "cx", "cy"]).where(
        F.expr(meet) & (F.col("cx") == corner("x")) & (F.col("cy") == corner("y"))
    )
    return found.select(F.col("a_part_id").alias("a"), F.col("b_part_id").alias("b"))


def _grid_edges(rings: pa.Array, grid: np.ndarray, origin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edges on the grid, row) of rows of rings, the first of each its shell."""
    count = nested.sizes(rings)
    each = rings.flatten()
    size = nested.sizes(each)
    row = np.repeat(np.arange(len(rings)), count)
    shell = np.arange(len(row)) == np.repeat(np.cumsum(count) - count, count)
    of_point = np.repeat(row, size)
    points = np.rint(nested.flat_points(each.flatten()) / grid[of_point, None]) - origin[of_point]
    e, ring = directed(points.astype(np.int64), size, shell)
    return e, row[ring]


#: So many rows are worked on at a time: what Python holds does not grow with an Arrow batch.
ROWS_AT_ONCE = 256


def _some(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(i, ROWS_AT_ONCE)


def _numbers(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in names]


def _polygon_rows(
    scene: np.ndarray, grid: np.ndarray, origin: np.ndarray, e: np.ndarray, group: np.ndarray
) -> pa.RecordBatch:
    """A row for each polygon of the groups' outlines."""
    made = polygons_of(e, group, len(scene))
    own = [[(r + origin[k]) * grid[k] for r in rings] for k, polygons in enumerate(made) for rings in polygons]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.repeat(scene, [len(p) for p in made]), pa.int64()), nested.rings_array(own)], ["scene_id", "rings"]
    )


def _alone(parts: DataFrame) -> DataFrame:
    """Parts that touch no other, as they are; invalid ones as the polygons of what they cover."""

    def rows(batches):
        for batch in batches:
            rings = batch.column(batch.schema.get_field_index("rings"))
            wrong = np.array(
                [
                    p is not None
                    for p in problems(pa.ListArray.from_arrays(nested.offsets(np.ones(len(rings), np.int64)), rings))
                ],
                bool,
            )
            fine = batch.filter(pa.array(~wrong))
            yield pa.RecordBatch.from_arrays([fine.column(0), fine.column(1)], ["scene_id", "rings"])
            if wrong.any():
                odd = batch.filter(pa.array(wrong))
                scene, grid, ox, oy = _numbers(odd, "scene_id", "grid", "ox", "oy")
                origin = np.stack([ox, oy], axis=1)
                e, row = _grid_edges(odd.column(1), grid, origin)
                yield _polygon_rows(scene, grid, origin, *united(e, row, np.arange(len(scene))))

    return parts.select("scene_id", "rings", "grid", "ox", "oy").mapInArrow(rows, _MERGED)


def _whole(clusters: DataFrame) -> DataFrame:
    """The polygons of clusters (scene_id, parts, grid, ox, oy), many at a time."""

    def rows(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                some = batch.slice(i, 512)
                scene, grid, ox, oy = _numbers(some, "scene_id", "grid", "ox", "oy")
                parts = some.column(some.schema.get_field_index("parts"))
                origin, of = np.stack([ox, oy], axis=1), np.repeat(np.arange(len(scene)), nested.sizes(parts))
                e, row = _grid_edges(parts.flatten(), grid[of], origin[of])
                yield _polygon_rows(scene, grid, origin, *united(e, row, of))

    return clusters.select("scene_id", "parts", "grid", "ox", "oy").mapInArrow(rows, _MERGED)


_PIECE = "scene_id bigint, cluster bigint, cell bigint, cx bigint, cy bigint, edges array<bigint>"


def _edge_lists(e: np.ndarray, owner: np.ndarray, n: int) -> pa.Array:
    """A list of coordinates, four an edge, for each owner 0..n - 1."""
    order = np.argsort(owner, kind="stable")
    return pa.ListArray.from_arrays(nested.offsets(4 * np.bincount(owner, minlength=n)), pa.array(e[order].ravel()))


def _cut(parts: DataFrame) -> DataFrame:
    """Parts (scene_id, cluster, cell, rings, grid, ox, oy) cut at the borders of their cluster's cells."""

    def rows(batches):
        for batch in _some(batches):
            scene, cluster, cell, grid, ox, oy = _numbers(batch, "scene_id", "cluster", "cell", "grid", "ox", "oy")
            e, row = _grid_edges(batch.column(batch.schema.get_field_index("rings")), grid, np.stack([ox, oy], axis=1))
            found = [(k, *piece) for k in np.unique(row).tolist() for piece in in_cells(e[row == k], int(cell[k]))]
            k, cx, cy = (np.array([f[j] for f in found], np.int64) for j in range(3))
            lists = pa.ListArray.from_arrays(
                nested.offsets(np.array([4 * len(f[3]) for f in found], np.int64)),
                pa.array(np.concatenate([f[3] for f in found]).ravel() if found else np.empty(0, np.int64)),
            )
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(v[k], pa.int64()) for v in (scene, cluster, cell)), pa.array(cx), pa.array(cy), lists],
                ["scene_id", "cluster", "cell", "cx", "cy", "edges"],
            )

    return parts.select("scene_id", "cluster", "cell", "rings", "grid", "ox", "oy").mapInArrow(rows, _PIECE)


def _united(pieces: DataFrame, *keys: str) -> DataFrame:
    """Pieces of equal keys as one: the boundary of their union."""
    grouped = pieces.groupBy("scene_id", "cluster", "cell", "cx", "cy", *keys).agg(
        F.collect_list("edges").alias("each")
    )

    def rows(batches):
        for batch in _some(batches):
            each = batch.column(batch.schema.get_field_index("each"))
            group = np.repeat(np.arange(len(each)), nested.sizes(each))
            lists = each.flatten()
            e = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)
            made, owner = united(e, np.repeat(np.arange(len(lists)), nested.sizes(lists) // 4), group)
            columns = [
                batch.column(batch.schema.get_field_index(c)) for c in ("scene_id", "cluster", "cell", "cx", "cy")
            ]
            yield pa.RecordBatch.from_arrays(
                [*columns, _edge_lists(made, owner, len(each))], ["scene_id", "cluster", "cell", "cx", "cy", "edges"]
            )

    return grouped.select("scene_id", "cluster", "cell", "cx", "cy", "each").mapInArrow(rows, _PIECE)


_EDGES = "scene_id bigint, cluster bigint, ax bigint, ay bigint, bx bigint, by bigint"
_IN_CELLS = _EDGES + ", cell bigint, cx bigint, cy bigint, axis bigint, at bigint, along bigint"


def _edge_rows(cells: DataFrame) -> DataFrame:
    """The edges of cells, with axis, at and cell_along of the border on which they lie; axis is null inside a cell."""

    def rows(batches):
        for batch in _some(batches):
            scene, cluster, cell, cx, cy = _numbers(batch, "scene_id", "cluster", "cell", "cx", "cy")
            lists = batch.column(batch.schema.get_field_index("edges"))
            e = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)
            k = np.repeat(np.arange(len(scene)), nested.sizes(lists) // 4)
            axis, at, along = np.full(len(e), -1), np.zeros(len(e), np.int64), np.zeros(len(e), np.int64)
            for a, (n, other) in enumerate(((cx, cy), (cy, cx))):
                for side in (0, 1):
                    line = (n[k] + side) * cell[k]
                    on = (e[:, a] == line) & (e[:, a + 2] == line)
                    axis[on], at[on], along[on] = a, line[on], other[k][on]
            columns = [scene[k], cluster[k], *e.T, cell[k], cx[k], cy[k], axis, at, along]
            names = ["scene_id", "cluster", "ax", "ay", "bx", "by", "cell", "cx", "cy", "axis", "at", "along"]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c), pa.int64()) for c in columns], names)

    return cells.select("scene_id", "cluster", "cell", "cx", "cy", "edges").mapInArrow(rows, _IN_CELLS)


def _borders(edges: DataFrame) -> DataFrame:
    """What is left of edges on cell borders where those of neighbours cancel, line by line."""
    upright = F.col("axis") == 0
    a, b = F.when(upright, F.col("ay")).otherwise(F.col("ax")), F.when(upright, F.col("by")).otherwise(F.col("bx"))
    lines = edges.where("axis >= 0").groupBy("scene_id", "cluster", "axis", "at", "along").agg(
        F.collect_list(F.array(a, b)).alias("each")
    )

    def rows(batches):
        for batch in batches:
            scene, cluster, axis, at = _numbers(batch, "scene_id", "cluster", "axis", "at")
            each = batch.column(batch.schema.get_field_index("each"))
            ends = each.flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, 2)
            line = np.repeat(np.arange(len(each)), nested.sizes(each))
            line, low, high, net = cancelled(
                line,
                ends.min(axis=1, initial=1 << 62),
                ends.max(axis=1, initial=-(1 << 62)),
                np.where(ends[:, 1] > ends[:, 0], 1, -1),
            )
            p, q = np.where(net > 0, low, high), np.where(net > 0, high, low)
            u, c = axis[line] == 0, at[line]
            columns = [
                scene[line], cluster[line], np.where(u, c, p), np.where(u, p, c), np.where(u, c, q), np.where(u, q, c)
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in columns], ["scene_id", "cluster", "ax", "ay", "bx", "by"]
            )

    return lines.select("scene_id", "cluster", "axis", "at", "each").mapInArrow(rows, _EDGES)


def _stitched(edges: DataFrame, grids: DataFrame) -> DataFrame:
    """The polygons of clusters' outlines; an outline, not what it covers, goes to one task."""
    outlines = edges.groupBy("scene_id", "cluster").agg(
        F.flatten(F.collect_list(F.array("ax", "ay", "bx", "by"))).alias("edges")
    )

    def rows(batches):
        for batch in batches:
            scene, grid, ox, oy = _numbers(batch, "scene_id", "grid", "ox", "oy")
            lists = batch.column(batch.schema.get_field_index("edges"))
            e = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)
            group = np.repeat(np.arange(len(scene)), nested.sizes(lists) // 4)
            yield _polygon_rows(scene, grid, np.stack([ox, oy], axis=1), e, group)

    return outlines.join(small(grids), "scene_id").select("scene_id", "edges", "grid", "ox", "oy").mapInArrow(
        rows, _MERGED
    )


def merged(polygons: DataFrame) -> DataFrame:
    """scene_id, parts: the union of touching and overlapping polygons, one row for each separate polygon.

    Parts whose boxes touch are clusters, by connected components. Most clusters are one part, which stays as it is if
    it is valid, or a few, which a task unites with many other clusters in one call. Larger ones are cut at the borders
    of grid cells: a task unites what a cell has (by CELL_PIECES at a time if there are more), and along cell borders
    edges of neighbours cancel, line by line. What is left is the outline of the union, which is stitched into rings;
    one of more than WHOLE_OUTLINE edges from chains in its cells (rings.py), so that no task holds it.

    Shapes are united on a grid of whole numbers, with a step of 2**-28 of their scene's extent (overlay.py):
    coordinates that are multiples of the step stay exact, others move by half a step at most, and by a step or so where
    edges cross. Null, empty and not finite parts are left out; a part that crosses itself covers what its rings wind
    around.
    """
    parts = boxed(polygons)
    grids = stored(gridded(parts))
    roots = stored(components(touching(parts)).select(F.col("node").alias("part_id"), F.col("root").alias("cluster")))
    known = parts.select(
        "scene_id",
        "part_id",
        "rings",
        F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")).alias("side"),
        "min_x",
        "min_y",
        "max_x",
        "max_y",
    )
    gridded_parts = known.join(small(grids), "scene_id")
    lone = gridded_parts.join(small(roots.select("part_id")), "part_id", "left_anti")
    sizes = stored(roots.groupBy("cluster").agg(F.count("*").alias("n_parts")))
    own = gridded_parts.join(small(roots), "part_id").join(small(sizes), "cluster")
    few = own.where(F.col("n_parts") <= WHOLE).groupBy("scene_id", "cluster").agg(
        F.collect_list("rings").alias("parts"), *[F.first(c).alias(c) for c in ("grid", "ox", "oy")]
    )
    out = _alone(lone).unionByName(_whole(few))
    if not sizes.where(F.col("n_parts") > WHOLE).isEmpty():
        out = out.unionByName(_merged_in_cells(own.where(F.col("n_parts") > WHOLE), grids))
    return out.select("scene_id", F.array("rings").alias("parts"))


def _merged_in_cells(parts: DataFrame, grids: DataFrame) -> DataFrame:
    extent = F.greatest(F.max("max_x") - F.min("min_x"), F.max("max_y") - F.min("min_y"))
    side = F.greatest(2 * F.percentile_approx("side", 0.5), extent / CELLS_ALONG)
    cells = stored(
        parts.groupBy("cluster").agg(F.greatest(F.ceil(side / F.first("grid")), F.lit(2)).cast("long").alias("cell"))
    )
    pieces = stored(_cut(parts.join(small(cells), "cluster")))
    at = ["scene_id", "cluster", "cx", "cy"]
    full = stored(pieces.groupBy(*at).agg(F.count("*").alias("n")).where(F.col("n") > CELL_PIECES))
    if not full.isEmpty():  # whatever their number, a task has CELL_PIECES of a cell, and then what comes of them
        salt = F.floor(F.rand(0) * F.ceil(F.coalesce("n", F.lit(1)) / CELL_PIECES)).cast("long")
        pieces = stored(_united(pieces.join(small(full), at, "left").withColumn("salt", salt), "salt"))
    edges = stored(_edge_rows(_united(pieces)))
    inner = edges.where("axis < 0").select("scene_id", "cluster", "cell", "cx", "cy", "ax", "ay", "bx", "by")
    # What is left on borders is on no cell's inside, whichever it is given to.
    border = _borders(edges).join(small(cells), "cluster")
    of = lambda c: F.floor(F.col(c) / F.col("cell")).cast("long")
    outline = stored(inner.unionByName(border.withColumns({"cx": of("ax"), "cy": of("ay")}).select(inner.columns)))
    discard(pieces, full, edges, cells)
    count = outline.groupBy("scene_id", "cluster").agg(F.count("*").alias("n_edges"))
    large = small(stored(count.where(F.col("n_edges") > WHOLE_OUTLINE).select("cluster")))
    out = _stitched(outline.join(large, "cluster", "left_anti"), grids)
    if large.isEmpty():
        return out
    by_cell = outline.join(large, "cluster", "left_semi").groupBy("scene_id", "cluster", "cell", "cx", "cy").agg(
        F.flatten(F.collect_list(F.array("ax", "ay", "bx", "by"))).alias("edges")
    )
    places = grids.select("scene_id", F.col("grid").alias("grid_x"), F.col("grid").alias("grid_y"), "ox", "oy")
    return out.unionByName(rings.mapped(rings.polygons(by_cell), places).select("scene_id", "rings"))


def fill_holes(polygons: DataFrame, min_hole_area: float) -> DataFrame:
    """Without holes smaller than ``min_hole_area``; without any if that is 0 or less. Empty results are dropped."""
    kept = lambda rings: F.concat(
        F.slice(rings, 1, 1),
        F.filter(F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))), lambda r: ring_area(r) >= min_hole_area),
    ) if min_hole_area > 0 else F.slice(rings, 1, 1)
    return usable(polygons.withColumn("parts", F.transform(F.filter("parts", lambda rings: F.size(rings) > 0), kept)))


def filter_area(polygons: DataFrame, min_area: float | None = None, max_area: float | None = None) -> DataFrame:
    """Polygons from ``min_area`` (if above 0) to ``max_area``, both included."""
    out = polygons
    if min_area is not None and min_area > 0:
        out = out.where(area(F.col("parts")) >= min_area)
    return out if max_area is None else out.where(area(F.col("parts")) <= max_area)


def spread(polygons: DataFrame) -> DataFrame:
    """polygons over all tasks: rings are slow to work on and small to store, so that a file of a few megabytes, which
    is one task's, can hold hours of work."""
    return polygons.repartition(int(polygons.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _changed(polygons: DataFrame, change) -> DataFrame:
    """polygons with parts made anew from flat arrays: change(points, ring of each, polygon of each ring) gives new
    points and the ring of each, ascending; a ring keeps its place, and is gone if it has no points."""
    at = polygons.columns.index("parts")

    def rows(batches):
        for batch in batches:
            parts = batch.column(at)
            flat = parts.flatten()
            rings = flat.flatten()
            n_parts, n_rings, size = nested.sizes(parts), nested.sizes(flat), nested.sizes(rings)
            polygon = np.repeat(np.repeat(np.arange(len(parts)), n_parts), n_rings)
            points, ring = change(nested.flat_points(rings.flatten()), np.repeat(np.arange(len(size)), size), polygon)
            each = pa.ListArray.from_arrays(
                nested.offsets(np.bincount(ring, minlength=len(size))), nested.points_array(points)
            )
            by_part = pa.ListArray.from_arrays(nested.offsets(n_rings), each)
            whole = pa.ListArray.from_arrays(
                nested.offsets(n_parts), by_part, mask=pa.array(~parts.is_valid().to_numpy(zero_copy_only=False))
            )
            yield batch.set_column(at, batch.schema.field(at), whole.cast(batch.schema.field(at).type))

    return polygons.mapInArrow(rows, polygons.schema)


def simplify(polygons: DataFrame, tolerance: float) -> DataFrame:
    """Douglas-Peucker on every ring, with topology kept: rings stay closed, and no shortcut crosses another ring or its
    own, or jumps over a ring. A valid polygon stays valid; in an invalid one, what was wrong may stay."""

    def change(points, ring, polygon):
        keep = simplified_together(points, ring, polygon, tolerance)
        return points[keep], ring[keep]

    return usable(_changed(spread(polygons), change))


def smooth(polygons: DataFrame, rounds: int) -> DataFrame:
    """Chaikin's corner cutting on every ring; a ring of under four points stays. Polygons are worked on where they lie;
    spread() them before."""

    def change(points, ring, polygon):
        whole = np.split(points, np.searchsorted(ring, np.arange(1, len(polygon)))) if len(polygon) else []
        made = [chaikin(r, rounds) if len(r) >= 4 else r for r in whole]
        return np.concatenate(made) if made else points, np.repeat(np.arange(len(made)), [len(r) for r in made])

    return _changed(polygons, change)


@dataclass(frozen=True)
class Steps:
    """The steps to take; None or False leaves one out."""

    merge: bool = False
    min_hole_area: float | None = None
    min_area: float | None = None
    max_area: float | None = None
    tolerance: float | None = None
    smooth_rounds: int | None = None

    def any(self) -> bool:
        return self.merge or any(
            v is not None
            for v in (self.min_hole_area, self.min_area, self.max_area, self.tolerance, self.smooth_rounds)
        )


def cleaned(polygons: DataFrame, steps: Steps) -> DataFrame:
    """scene_id, parts, area after the steps in their order: areas are filtered before shapes are simplified and
    smoothed."""
    if not steps.any():
        raise ValueError("no step is enabled")
    out = usable(polygons)
    check_not_empty(out, "polygons with a geometry")
    out = merged(out) if steps.merge else out.select("scene_id", "parts")
    if steps.min_hole_area is not None:
        out = fill_holes(out, steps.min_hole_area)
    out = filter_area(out, steps.min_area, steps.max_area)
    if steps.tolerance is not None:
        out = simplify(out, steps.tolerance)
    if steps.smooth_rounds is not None:
        out = smooth(out if steps.tolerance is not None else spread(out), steps.smooth_rounds)
    return out.withColumn("area", area(F.col("parts")))


