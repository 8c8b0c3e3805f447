"""Regions of positive pixels as polygons: labels in blocks, joined over their borders, then rings."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segjobs.functions import nested, overlay
from segjobs.functions.geometry import labelled
from segjobs.functions.graph import components
from segjobs.functions.shared import small, stored
from segjobs.operators import rings
from segjobs.operators.clean import area

BLOCK = 64
#: Boundaries of more edges are put together from chains.
WHOLE_BOUNDARY = 1_000_000


def regions(mask: DataFrame, block: int = BLOCK) -> DataFrame:
    """scene_id, y, x, region, first_y, first_x of the positive pixels (scene_id, y, x): one region for each 4-connected
    set. first_y, first_x is its first pixel by row and column; region is a 64-bit hash of that and the scene.

    A block's pixels are labelled in one task; labels that meet at block borders are edges of a graph, whose
    components are found by joins. Only border pixels and labels take part in those. Scenes may have any number
    and size; two regions under one hash raise an error.
    """

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x"], ignore_index=True)
        y, x = pdf["y"].to_numpy(), pdf["x"].to_numpy()
        k = labelled(y, x)
        return pd.DataFrame({"scene_id": pdf["scene_id"], "y": y, "x": x, "label_y": y[k], "label_x": x[k]})

    keyed = mask.select(
        F.col("scene_id").cast("long").alias("scene_id"),
        F.col("y").cast("long").alias("y"),
        F.col("x").cast("long").alias("x"),
    ).withColumns({"by": F.floor(F.col("y") / block), "bx": F.floor(F.col("x") / block)})
    made = keyed.groupBy("scene_id", "by", "bx").applyInPandas(
        lambda pdf: local(pdf[["scene_id", "y", "x"]]),
        "scene_id bigint, y bigint, x bigint, label_y bigint, label_x bigint",
    )
    own = stored(made.withColumn("label", F.xxhash64("scene_id", "label_y", "label_x")))
    edges = None
    for axis, other in (("x", "y"), ("y", "x")):
        low = own.where(F.col(axis) % block == block - 1).select(
            "scene_id", other, (F.col(axis) + 1).alias(axis), F.col("label").alias("a")
        )
        high = own.where(F.col(axis) % block == 0).select("scene_id", other, axis, F.col("label").alias("b"))
        pairs = low.join(high, ["scene_id", other, axis]).select("a", "b").distinct()
        edges = pairs if edges is None else edges.unionByName(pairs)
    roots = components(edges).select(F.col("node").alias("label"), "root")
    labels = own.groupBy("scene_id", "label").agg(
        F.min(F.struct("label_y", "label_x")).alias("first"), F.max(F.struct("label_y", "label_x")).alias("last")
    )
    labels = stored(labels.join(roots, "label", "left").withColumn("root", F.coalesce("root", "label")))
    twice = labels.groupBy("label").agg(F.count("*").alias("n")).where("n > 1")
    if not labels.where("first <> last").isEmpty() or not twice.isEmpty():
        raise RuntimeError("two regions have one hash")
    firsts = labels.groupBy("scene_id", "root").agg(F.min("first").alias("first"))
    named = labels.select("scene_id", "label", "root").join(firsts, ["scene_id", "root"]).select(
        "scene_id", "label", "first.*"
    )
    named = named.select(
        "scene_id",
        "label",
        F.xxhash64("scene_id", "label_y", "label_x").alias("region"),
        F.col("label_y").alias("first_y"),
        F.col("label_x").alias("first_x"),
    )
    return own.select("scene_id", "y", "x", "label").join(small(stored(named)), ["scene_id", "label"]).drop("label")


def region_summary(found: DataFrame, scenes: DataFrame) -> DataFrame:
    """scene_id, region, n_pixels, area, pixel bounds and first pixel; class is 1 for all."""
    own = found.groupBy("scene_id", "region").agg(
        F.count("*").alias("n_pixels"),
        F.min("x").alias("x0"),
        F.max("x").alias("x1"),
        F.min("y").alias("y0"),
        F.max("y").alias("y1"),
        F.min("first_y").alias("first_y"),
        F.min("first_x").alias("first_x"),
    )
    return own.join(scenes.select("scene_id", "gt"), "scene_id").select(
        "scene_id",
        "region",
        F.lit(1).alias("class"),
        "n_pixels",
        (F.col("n_pixels") * F.abs(F.col("gt.pw") * F.col("gt.ph"))).alias("area"),
        "x0",
        "x1",
        "y0",
        "y1",
        "first_y",
        "first_x",
    )


def boundaries(found: DataFrame) -> DataFrame:
    """scene_id, region, first_y, first_x, ax, ay, bx, by: unit edges between a region and what is not of it, the region
    on their left as x and y grow.

    Each pixel has four; those that two pixels share cancel, in one aggregate over edges.
    """
    edge = lambda ax, ay, bx, by: F.struct(
        (F.col("x") + ax).alias("ax"),
        (F.col("y") + ay).alias("ay"),
        (F.col("x") + bx).alias("bx"),
        (F.col("y") + by).alias("by"),
    )
    around = F.array(edge(0, 0, 1, 0), edge(1, 0, 1, 1), edge(1, 1, 0, 1), edge(0, 1, 0, 0))
    own = ("scene_id", "region", "first_y", "first_x")
    rows = found.select(*own, F.explode(around).alias("e"))
    key = F.array_sort(
        F.array(
            F.struct(F.col("e.ax").alias("x"), F.col("e.ay").alias("y")),
            F.struct(F.col("e.bx").alias("x"), F.col("e.by").alias("y")),
        )
    )
    single = rows.groupBy(*own, key.alias("k")).agg(F.count("*").alias("n"), F.first("e").alias("e")).where("n = 1")
    return single.select(*own, "e.*")


_POLYGONS = "poly_id bigint, scene_id bigint, parts array<array<array<struct<x:double,y:double>>>>, area double, first_y bigint, first_x bigint"


def polygons_of(found: DataFrame, scenes: DataFrame) -> DataFrame:
    """poly_id (the region), scene_id, parts in map coordinates, area and first pixel. A region's boundary, not its
    pixels, goes to one task; rings of many regions are made in one call, on whole numbers. A boundary of more than
    WHOLE_BOUNDARY edges is put together from chains in blocks of BLOCK pixels, so that no task holds it."""
    unit = stored(boundaries(found))
    count = unit.groupBy("scene_id", "region").agg(F.count("*").alias("n")).where(F.col("n") > WHOLE_BOUNDARY)
    large = small(stored(count.select("scene_id", "region")))
    some = unit.join(large, ["scene_id", "region"], "left_anti")
    out = _whole_polygons(some, scenes)
    return out if large.isEmpty() else out.unionByName(
        _chained_polygons(unit.join(large, ["scene_id", "region"], "left_semi"), scenes)
    )


def _chained_polygons(unit: DataFrame, scenes: DataFrame) -> DataFrame:
    # Edges of a block; those on its border are on no block's inside.
    of = lambda a, b: F.floor(F.least(a, b) / BLOCK).cast("long")
    cells = unit.groupBy(
        "scene_id",
        F.col("region").alias("cluster"),
        F.lit(BLOCK).cast("long").alias("cell"),
        of("ax", "bx").alias("cx"),
        of("ay", "by").alias("cy"),
    )
    made = rings.polygons(cells.agg(F.flatten(F.collect_list(F.array("ax", "ay", "bx", "by"))).alias("edges")))
    gt = scenes.select(
        "scene_id",
        F.col("gt.pw").alias("grid_x"),
        F.col("gt.ph").alias("grid_y"),
        (F.col("gt.x0") / F.col("gt.pw")).alias("ox"),
        (F.col("gt.y0") / F.col("gt.ph")).alias("oy"),
    )
    first = unit.groupBy("scene_id", F.col("region").alias("cluster")).agg(
        F.first("first_y").alias("first_y"), F.first("first_x").alias("first_x")
    )
    own = rings.mapped(made, gt).join(first, ["scene_id", "cluster"]).withColumn("parts", F.array("rings"))
    return own.select(
        F.col("cluster").alias("poly_id"), "scene_id", "parts", area(F.col("parts")).alias("area"), "first_y", "first_x"
    )


def _whole_polygons(unit: DataFrame, scenes: DataFrame) -> DataFrame:
    edges = unit.groupBy("scene_id", "region", "first_y", "first_x").agg(
        F.flatten(F.collect_list(F.array("ax", "ay", "bx", "by"))).alias("edges")
    )
    own = edges.join(scenes.select("scene_id", "gt.x0", "gt.pw", "gt.y0", "gt.ph"), "scene_id")

    def rows(batches):
        for batch in batches:
            scene, region, y, x, x0, pw, y0, ph = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(8))
            lists = batch.column(8)
            e = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, 4)
            made = overlay.polygons_of(e, np.repeat(np.arange(len(scene)), nested.sizes(lists) // 4), len(scene))
            size = [
                sum(overlay.doubled_area(r) for r in own) / 2 * abs(a * b)
                for (own,), a, b in zip(made, pw, ph, strict=True)
            ]
            mapped = [
                [r * np.array([pw[k], ph[k]]) + np.array([x0[k], y0[k]]) for r in own] for k, (own,) in enumerate(made)
            ]
            parts = pa.ListArray.from_arrays(nested.offsets(np.ones(len(scene), np.int64)), nested.rings_array(mapped))
            columns = [pa.array(region), pa.array(scene), parts, pa.array(size, pa.float64()), pa.array(y), pa.array(x)]
            yield pa.RecordBatch.from_arrays(columns, ["poly_id", "scene_id", "parts", "area", "first_y", "first_x"])

    return own.select("scene_id", "region", "first_y", "first_x", "x0", "pw", "y0", "ph", "edges").mapInArrow(
        rows, _POLYGONS
    )
