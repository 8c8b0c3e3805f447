"""Scoring scenes tile by tile, and blending overlapping tiles into one map."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from segjobs.operators.blocks import arrays, parts_of, placed
from segjobs.operators.grid import prediction_stride
from segjobs.operators.losses import sigmoid

Scorer = Callable[[np.ndarray], np.ndarray]


def prediction_tiles(
    pixels: DataFrame, scenes: DataFrame, size: int, overlap: float, bands: list[str], nodata: float | None = None
) -> DataFrame:
    """scene_id, col0, row0, size, read_w, read_h and bands, with 0 where a tile reaches over the scene's edge.

    A pixel goes to every tile that covers it; one shuffle by tile. blocks.prediction_tiles() has the same rows from
    blocks, for a shuffle of about the pixels once. A missing pixel within the scene is null, or nodata, and its tile's
    other pixels keep their places; two rows of one pixel are an error; a tile without any pixel has no row.
    """
    stride = prediction_stride(size, overlap)
    along = lambda c: F.explode(
        F.sequence(
            F.greatest(F.floor((F.col(c) - size) / stride) + 1, F.lit(0)).cast("long"),
            F.floor(F.col(c) / stride).cast("long"),
        )
    )
    placed_in = pixels.withColumn("col0", along("x")).withColumn("row0", along("y")).withColumns(
        {"col0": F.col("col0") * stride, "row0": F.col("row0") * stride}
    )
    at = ((F.col("y") - F.col("row0")) * size + F.col("x") - F.col("col0")).cast("int")
    grouped = placed_in.groupBy("scene_id", "col0", "row0").agg(
        F.collect_list(F.struct(at.alias("p"), *[F.col(b).cast("double").alias(b) for b in bands])).alias("v")
    )
    read = lambda n, c: F.least(F.lit(size), F.col(n) - F.col(c)).cast("long")
    own = grouped.join(scenes.select("scene_id", "width", "height"), "scene_id").withColumns(
        {"read_w": read("width", "col0"), "read_h": read("height", "row0")}
    ).where("read_w > 0 AND read_h > 0")

    def rows(batches):
        for whole in batches:
            for batch in parts_of(whole, size * size * len(bands)):
                values, missing = placed(batch.column(5), size * size, nodata)
                w, h = (batch.column(k).to_numpy()[:, None, None] for k in (3, 4))
                y, x = np.divmod(np.arange(size * size), size)
                outside = np.broadcast_to((x >= w) | (y >= h), values.shape)
                values[outside], missing[outside] = 0.0, False
                columns = [
                    *(batch.column(k) for k in range(3)),
                    pa.array(np.full(batch.num_rows, size, np.int32)),
                    batch.column(3),
                    batch.column(4),
                ]
                yield pa.RecordBatch.from_arrays(
                    [*columns, arrays(values, missing)],
                    ["scene_id", "col0", "row0", "size", "read_w", "read_h", "bands"],
                )

    kept = own.select(
        F.col("scene_id").cast("long").alias("scene_id"),
        F.col("col0").cast("long").alias("col0"),
        F.col("row0").cast("long").alias("row0"),
        "read_w",
        "read_h",
        "v",
    )
    return kept.mapInArrow(
        rows,
        "scene_id bigint, col0 bigint, row0 bigint, size int, read_w bigint, read_h bigint, bands array<array<double>>",
    )


def linear_scores(tiles: DataFrame, weights: list[float], bias: float) -> DataFrame:
    """tiles with prob, the sigmoid of a weighted sum of bands: columns alone."""
    z = lambda p: sum((w * F.col("bands")[k][p] for k, w in enumerate(weights)), F.lit(float(bias)))
    return tiles.withColumn(
        "prob", F.transform(F.sequence(F.lit(0), F.col("size") * F.col("size") - 1), lambda p: sigmoid(z(p)))
    )


def scored(tiles: DataFrame, make_scorer: Callable[[], Scorer], batch: int = 8) -> DataFrame:
    """tiles with prob from a model: make_scorer() is called once a task and gives f(B x C x H x W) -> logits B x H x W
    (of a list, the last item counts). Tiles go through in groups of up to ``batch`` of one size, so memory is bounded
    by tile size; bands must be whole, without nulls."""
    names = tiles.columns

    def rows(found):
        scorer = make_scorer()
        for b in found:
            sizes = b.column(names.index("size")).to_numpy(zero_copy_only=False)
            i = 0
            while i < b.num_rows:
                size = int(sizes[i])
                n = int(np.argmax(np.append(sizes[i : i + batch] != size, True)))
                part = b.slice(i, n)
                values = part.column(names.index("bands")).flatten().flatten().to_numpy(zero_copy_only=False)
                z = scorer(np.asarray(values, np.float64).reshape(n, -1, size, size))
                z = np.asarray(z[-1] if isinstance(z, list) else z, np.float64).reshape(n, size * size)
                offsets = pa.array(np.arange(n + 1, dtype=np.int32) * (size * size))
                prob = pa.ListArray.from_arrays(offsets, pa.array((1 / (1 + np.exp(-z))).ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, prob], [*names, "prob"])
                i += n

    return tiles.mapInArrow(rows, StructType([*tiles.schema.fields, StructField("prob", ArrayType(DoubleType()))]))


def blended(tiles: DataFrame, block: int) -> DataFrame:
    """scene_id, block_x, block_y and mean: blocks of block x block, in each pixel the mean chance of the tiles over it.

    Tiles of any size and stride are cut at the borders of the output's blocks, and only those pieces travel: one
    shuffle by block, with about ((size + block) / stride)**2 pieces each. A pixel's mean is over the tiles that read
    it; pixels that none did, outside the scene, are null.
    """
    first, last = lambda c: F.floor(F.col(c) / block), lambda c, n: F.floor(
        (F.col(c) + F.col(n) - 1) / block
    )
    cut = tiles.withColumn("block_y", F.explode(F.sequence(first("row0"), last("row0", "read_h"))))
    cut = cut.withColumn("block_x", F.explode(F.sequence(first("col0"), last("col0", "read_w"))))
    top, left = F.greatest(F.col("block_y") * block, F.col("row0")), F.greatest(F.col("block_x") * block, F.col("col0"))
    bottom = F.least((F.col("block_y") + 1) * block, F.col("row0") + F.col("read_h"))
    right = F.least((F.col("block_x") + 1) * block, F.col("col0") + F.col("read_w"))
    row = lambda y: F.slice(
        "prob", ((y - F.col("row0")) * F.col("size") + F.col("x0") - F.col("col0") + 1).cast("int"), F.col("width")
    )
    cut = cut.withColumns(
        {"y0": top, "x0": left, "height": (bottom - top).cast("int"), "width": (right - left).cast("int")}
    )
    part = F.transform(F.sequence(F.lit(0), F.col("height") - 1), lambda k: row(F.col("y0") + k))
    piece = F.struct(
        "row0",
        "col0",
        (F.col("y0") - F.col("block_y") * block).cast("int").alias("y"),
        (F.col("x0") - F.col("block_x") * block).cast("int").alias("x"),
        "height",
        "width",
        part.alias("rows"),
    )
    pieces = cut.select("scene_id", "block_x", "block_y", piece.alias("piece"))
    grouped = pieces.groupBy("scene_id", "block_x", "block_y").agg(
        F.array_sort(F.collect_list("piece")).alias("pieces")
    )
    over = lambda p, y, x: (p["y"] <= y) & (y < p["y"] + p["height"]) & (p["x"] <= x) & (
        x < p["x"] + p["width"]
    )

    def pixel(q):
        y, x = F.floor(q / block).cast("int"), (q % block).cast("int")
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"))
        add = lambda a, p: F.when(
            over(p, y, x),
            F.struct((a["sum"] + p["rows"][y - p["y"]][x - p["x"]]).alias("sum"), (a["n"] + 1).alias("n")),
        ).otherwise(a)
        return F.aggregate("pieces", start, add, lambda a: F.when(a["n"] > 0, a["sum"] / a["n"]))

    return grouped.select(
        "scene_id",
        "block_x",
        "block_y",
        F.transform(F.sequence(F.lit(0), F.lit(block * block - 1)), pixel).alias("mean"),
    )


def blended_pixels(blocks: DataFrame, block: int) -> DataFrame:
    """scene_id, y, x, mean of the blocks' pixels inside the scene."""
    rows = blocks.select("scene_id", "block_x", "block_y", F.posexplode("mean").alias("q", "mean")).where(
        "mean IS NOT NULL"
    )
    y, x = F.col("block_y") * block + F.floor(F.col("q") / block), F.col("block_x") * block + F.col("q") % block
    return rows.select("scene_id", y.alias("y"), x.alias("x"), "mean")


def positive(blended: DataFrame, threshold: float = 0.5) -> DataFrame:
    """blended pixels with mask: 1 if the mean is over the threshold, strictly."""
    if not 0 < threshold < 1:
        raise ValueError(f"threshold {threshold} is not between 0 and 1")
    return blended.withColumn("mask", (F.col("mean") > threshold).cast("int"))


def prediction_summary(scenes: DataFrame, tiles: DataFrame, outputs: str = "both") -> DataFrame:
    n = tiles.groupBy("scene_id").agg(F.count("*").alias("n_tiles"))
    return scenes.join(n, "scene_id", "left").select(
        "scene_id",
        "width",
        "height",
        F.coalesce("n_tiles", F.lit(0).cast("long")).alias("n_tiles"),
        F.lit(outputs).alias("outputs"),
    )
