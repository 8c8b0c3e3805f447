"""Rings of outlines that no single task holds: chains of edges in cells, ranked into rings by pointer doubling.

An outline's edges lie in the cells of a grid. In a cell, edges follow each other through vertices inside of it, so a
task turns them into chains from border to border, and into the rings that lie inside the cell. At vertices on borders
chains are paired with the chains that follow. A ring is then a circle of chains; in rounds whose number grows as
the logarithm of its length, each chain learns the least number in its circle and how far it is to that one. Only
chains' numbers travel in these rounds; their points are put together once, ring by ring.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segjobs.functions import nested
from segjobs.functions.overlay import apart, below, corners, cross, doubled_area, simple_rings, successors, vertices
from segjobs.functions.shared import discard, small, stored

MAX_ROUNDS = 60
_CHAIN = "scene_id bigint, cluster bigint, sx bigint, sy bigint, fx bigint, fy bigint, lx bigint, ly bigint, ex bigint, ey bigint, closed boolean, points array<bigint>"
_NAMES = ["scene_id", "cluster", "sx", "sy", "fx", "fy", "lx", "ly", "ex", "ey", "closed", "points"]


def chains(cells: DataFrame) -> DataFrame:
    """Chains of the edges of cells (scene_id, cluster, cell, cx, cy, edges): start, second, last but one and end point,
    whether it is a closed ring, and all points but the end. Edges along a cell's border are chains of one edge."""

    def rows(batches):
        for batch in batches:
            scene, cluster, cell, cx, cy = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
            lists = batch.column(5)
            e = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, 4)
            group = np.repeat(np.arange(len(scene)), nested.sizes(lists) // 4)
            walks, closed = _walks(e, group, cell, cx, cy)
            if not walks:
                continue
            first, last = np.array([w[0] for w in walks]), np.array([w[-1] for w in walks])
            points = pa.ListArray.from_arrays(
                nested.offsets(np.array([2 * len(w) for w in walks])), pa.array(e[np.concatenate(walks), :2].ravel())
            )
            g = group[first]
            columns = [
                scene[g],
                cluster[g],
                e[first, 0],
                e[first, 1],
                e[first, 2],
                e[first, 3],
                e[last, 0],
                e[last, 1],
                e[last, 2],
                e[last, 3],
            ]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in columns), pa.array(closed, pa.bool_()), points], _NAMES
            )

    return cells.select("scene_id", "cluster", "cell", "cx", "cy", "edges").mapInArrow(rows, _CHAIN)


def _walks(e: np.ndarray, group: np.ndarray, cell: np.ndarray, cx: np.ndarray, cy: np.ndarray) -> tuple[
    list[np.ndarray], list[bool]
]:
    if not len(e):
        return [], []
    size, left, low = cell[group], cx[group] * cell[group], cy[group] * cell[group]
    on_border = lambda x, y: (x <= left) | (x >= left + size) | (y <= low) | (y >= low + size)
    moved, _, _ = apart(e, group, len(cell))
    starts, ends = vertices(moved)
    inner = ~on_border(e[:, 2], e[:, 3])
    follow = successors(moved, starts, ends, inner).tolist()
    begins = on_border(e[:, 0], e[:, 1])
    seen, walks, closed = [False] * len(e), [], []
    order = np.argsort(starts, kind="stable")
    for k in [*order[begins[order]].tolist(), *order[~begins[order]].tolist()]:
        walk, here = [], k
        while here >= 0 and not seen[here]:
            seen[here] = True
            walk.append(here)
            here = follow[here]
        if walk:
            walks.append(np.array(walk))
            closed.append(here >= 0)
    return walks, closed


def _links(open_chains: DataFrame) -> DataFrame:
    """(id, next) of open chains: at each vertex the chain that arrives and the one with the sharpest turn to the
    left."""
    arriving = open_chains.select(
        "scene_id",
        "cluster",
        F.col("ex").alias("x"),
        F.col("ey").alias("y"),
        F.struct("id", (F.col("ex") - F.col("lx")).alias("dx"), (F.col("ey") - F.col("ly")).alias("dy")).alias(
            "arrives"
        ),
        F.lit(None).cast("struct<id:bigint,dx:bigint,dy:bigint>").alias("leaves"),
    )
    leaving = open_chains.select(
        "scene_id",
        "cluster",
        F.col("sx").alias("x"),
        F.col("sy").alias("y"),
        F.lit(None).cast("struct<id:bigint,dx:bigint,dy:bigint>").alias("arrives"),
        F.struct("id", (F.col("fx") - F.col("sx")).alias("dx"), (F.col("fy") - F.col("sy")).alias("dy")).alias(
            "leaves"
        ),
    )
    at = arriving.unionByName(leaving).groupBy("scene_id", "cluster", "x", "y").agg(
        F.collect_list("arrives").alias("arrives"), F.collect_list("leaves").alias("leaves")
    )
    single = at.where("size(arrives) = 1 AND size(leaves) = 1").select(
        F.col("arrives")[0]["id"].alias("id"), F.col("leaves")[0]["id"].alias("next")
    )

    def rows(batches):
        for batch in batches:
            found = []
            for arrives, leaves in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for a in arrives:
                    d, best = (a["dx"], a["dy"]), None
                    for x in leaves:
                        o = (x["dx"], x["dy"])
                        to_left = cross(*d, *o) > 0
                        if best is None or (to_left > best[1] if to_left != best[1] else cross(*best[2], *o) > 0):
                            best = (x["id"], to_left, o)
                    found.append((a["id"], best[0]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["id", "next"]
            )

    several = at.where("size(arrives) > 1").select("arrives", "leaves").mapInArrow(rows, "id bigint, next bigint")
    return single.unionByName(several)


def ranked_circles(links: DataFrame) -> DataFrame:
    """(id, ring, place) of links (id, next) that form circles: ring is a circle's least id, which has place 0, and
    places follow the links. Twice as many rounds as the logarithm of the longest circle; each is one join by unique
    ids, written to the shared folder, and the one before it deleted."""
    now = stored(links.select("id", "next", F.col("id").alias("ring")))
    first = now
    for _ in range(MAX_ROUNDS):
        ahead = now.select(F.col("id").alias("next"), F.col("next").alias("then"), F.col("ring").alias("other"))
        after = stored(
            now.join(ahead, "next").select(
                "id",
                F.col("then").alias("next"),
                F.least("ring", "other").alias("ring"),
                (F.col("other") < F.col("ring")).alias("changed"),
            )
        )
        if now is not first:
            discard(now)
        now = after
        # Of two stretches side by side both have the least number of the two only if they overlap: then they are the
        # whole circle.
        if now.where("changed").isEmpty():
            break
    else:
        raise RuntimeError("circles did not settle")
    rings = now.select("id", "ring")
    start = first.select("id", "next").join(rings, "id")
    rows = start.select(
        "id",
        "ring",
        F.when(F.col("id") == F.col("ring"), F.col("id")).otherwise(F.col("next")).alias("to"),
        (F.col("id") != F.col("ring")).cast("long").alias("far"),
    )
    now = stored(rows)
    for _ in range(MAX_ROUNDS):
        # Those that have arrived need no more: so no id is asked for by many.
        going = now.where("to <> ring")
        if going.isEmpty():
            break
        ahead = now.select(F.col("id").alias("to"), F.col("to").alias("then"), F.col("far").alias("more"))
        moved = going.join(ahead, "to").select(
            "id", "ring", F.col("then").alias("to"), (F.col("far") + F.col("more")).alias("far")
        )
        after = stored(now.where("to = ring").unionByName(moved))
        discard(now)
        now = after
    else:
        raise RuntimeError("circles did not settle")
    whole = now.select("id", "ring", "far", F.max("far").over(Window.partitionBy("ring")).alias("most"))
    return whole.select(
        "id", "ring", F.when(F.col("far") == 0, 0).otherwise(F.col("most") - F.col("far") + 1).alias("place")
    )


_RING = "scene_id bigint, cluster bigint, shell boolean, area double, x0 bigint, y0 bigint, x1 bigint, y1 bigint, mx bigint, my bigint, points array<bigint>"


def rings(found: DataFrame) -> DataFrame:
    """Simple rings of chains (from chains() of all cells, stored, with id): scene_id, cluster, shell, area, box, the
    doubled middle of an edge, and points (x and y in turn, closed, without those on straight runs)."""
    open_chains = found.where("NOT closed")
    places = ranked_circles(_links(open_chains))
    joined = open_chains.join(places, "id").groupBy("scene_id", "cluster", "ring").agg(
        F.array_sort(F.collect_list(F.struct("place", "points"))).alias("p")
    )
    whole = joined.select("scene_id", "cluster", F.flatten("p.points").alias("points")).unionByName(
        found.where("closed").select("scene_id", "cluster", "points")
    )

    def rows(batches):
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                p = batch.column(2)[k].values.to_numpy(zero_copy_only=False).reshape(-1, 2)
                e = np.concatenate([p, np.roll(p, -1, axis=0)], axis=1)
                starts, _ = vertices(e)
                for ring in simple_rings(list(range(len(e))), starts.tolist()):
                    c = corners(e, ring)
                    if len(c) >= 4 and (a := doubled_area(c)):
                        middle = e[ring[0], :2] + e[ring[0], 2:]
                        out.append(
                            (
                                batch.column(0)[k].as_py(),
                                batch.column(1)[k].as_py(),
                                a > 0,
                                abs(a) / 2,
                                *c.min(axis=0).tolist(),
                                *c.max(axis=0).tolist(),
                                *middle.tolist(),
                                c.ravel(),
                            )
                        )
            types = [pa.int64(), pa.int64(), pa.bool_(), pa.float64(), *[pa.int64()] * 6]
            lists = pa.ListArray.from_arrays(
                nested.offsets(np.array([len(o[10]) for o in out], np.int64)),
                pa.array(np.concatenate([o[10] for o in out]) if out else np.empty(0, np.int64), pa.int64()),
            )
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([o[j] for o in out], t) for j, t in enumerate(types)), lists],
                ["scene_id", "cluster", "shell", "area", "x0", "y0", "x1", "y1", "mx", "my", "points"],
            )

    return whole.mapInArrow(rows, _RING)


def _around(shells: DataFrame, holes: DataFrame) -> DataFrame:
    """(shell_id, hole_id) of the least shell of its cluster around each hole, by the parity of the shell's edges below
    it."""
    inside = "x0 <= hx0 AND hx1 <= x1 AND y0 <= hy0 AND hy1 <= y1"
    own = holes.select(
        "scene_id",
        "cluster",
        F.col("ring_id").alias("hole_id"),
        "mx",
        "my",
        *[F.col(c).alias(f"h{c}") for c in ("x0", "y0", "x1", "y1")],
    )
    boxed = shells.select("scene_id", "cluster", F.col("ring_id").alias("shell_id"), "area", "x0", "y0", "x1", "y1")
    pairs = stored(
        own.join(boxed, ["scene_id", "cluster"]).where(inside).select("shell_id", "area", "hole_id", "mx", "my")
    )
    many = F.count("*").over(Window.partitionBy("hole_id"))
    counted = pairs.withColumn("many", many)
    doubtful = counted.where("many > 1").groupBy("shell_id").agg(
        F.collect_list(F.struct("hole_id", "mx", "my")).alias("holes")
    )
    asked = shells.select(F.col("ring_id").alias("shell_id"), "area", "points").join(doubtful, "shell_id")

    def rows(batches):
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                c = batch.column(2)[k].values.to_numpy(zero_copy_only=False).reshape(-1, 2)
                e = np.concatenate([c[:-1], c[1:]], axis=1)
                e = np.where((e[:, 0] > e[:, 2])[:, None], e[:, [2, 3, 0, 1]], e)
                listed = batch.column(3)[k].values
                middle = np.stack([listed.field(j).to_numpy() for j in (1, 2)], axis=1)
                odd = np.zeros(len(middle), np.int64)
                for _, i in below(e, middle, np.zeros(len(middle), bool)):
                    np.add.at(odd, i, 1)
                out += [
                    (batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), h)
                    for h in listed.field(0).to_numpy()[odd % 2 == 1].tolist()
                ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[j] for o in out], t) for j, t in enumerate((pa.int64(), pa.float64(), pa.int64()))],
                ["shell_id", "area", "hole_id"],
            )

    sure = asked.mapInArrow(rows, "shell_id bigint, area double, hole_id bigint")
    all_pairs = counted.where("many = 1").select("shell_id", "area", "hole_id").unionByName(sure)
    return all_pairs.groupBy("hole_id").agg(F.min_by("shell_id", "area").alias("shell_id"))


def polygons(cells: DataFrame) -> DataFrame:
    """scene_id, cluster and rings (points of x and y in turn; the shell first) of the polygons of outlines in cells
    (scene_id, cluster, cell, cx, cy, edges). A polygon is a row, whatever its size; no task holds more of others."""
    found = stored(chains(cells).withColumn("id", F.monotonically_increasing_id()))
    made = stored(rings(found).withColumn("ring_id", F.monotonically_increasing_id()))
    shells, holes = made.where("shell"), made.where("NOT shell")
    of = _around(shells, holes)
    inner = holes.select(F.col("ring_id").alias("hole_id"), "points").join(of, "hole_id").groupBy("shell_id").agg(
        F.collect_list("points").alias("inner")
    )
    own = shells.select("scene_id", "cluster", F.col("ring_id").alias("shell_id"), "points").join(
        inner, "shell_id", "left"
    )
    rings_of = F.concat(F.array("points"), F.coalesce("inner", F.array().cast("array<array<bigint>>")))
    return own.select("scene_id", "cluster", rings_of.alias("rings"))


def mapped(found: DataFrame, grids: DataFrame) -> DataFrame:
    """polygons() in the coordinates of grids (scene_id, grid_x, grid_y, ox, oy: step and origin in steps): scene_id,
    cluster, rings."""
    joined = found.join(small(grids), "scene_id")
    point = lambda r, i: F.struct(
        ((r[2 * i] + F.col("ox")) * F.col("grid_x")).alias("x"),
        ((r[2 * i + 1] + F.col("oy")) * F.col("grid_y")).alias("y"),
    )
    ring = lambda r: F.transform(
        F.sequence(F.lit(0), (F.size(r) / 2 - 1).cast("int")), lambda i: point(r, i)
    )
    return joined.select("scene_id", "cluster", F.transform("rings", ring).alias("rings"))
