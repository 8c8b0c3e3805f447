"""Tile grids of scenes: training windows and prediction windows, by arithmetic on a scene's size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOLERANCE = 1e-9


def windows_along(size: Column, window: int, stride: int) -> Column:
    """How many full windows fit along an axis; 0 if the scene is smaller than one."""
    return F.greatest(F.floor((size - window + TOLERANCE) / stride) + 1, F.lit(0)).cast("long")


def clean_name(name: Column) -> Column:
    """Letters, digits, ``_`` and ``-`` stay, others become ``_``; none at the ends; ``dataset`` if nothing is left."""
    cleaned = F.btrim(F.regexp_replace(name, r"[^\p{L}\p{N}_-]", "_"), F.lit("_"))
    return F.when(cleaned == "", "dataset").otherwise(cleaned)


def tile_transform(col0: Column, row0: Column) -> Column:
    """The geotransform of a tile from its scene's (column gt); square pixels."""
    x, y = F.col("gt.x0") + col0 * F.col("gt.pw"), F.col("gt.y0") - row0 * F.col("gt.pw")
    return F.struct(
        x.alias("x0"),
        F.col("gt.pw").alias("pw"),
        F.lit(0.0).alias("rx"),
        y.alias("y0"),
        F.lit(0.0).alias("ry"),
        (-F.col("gt.pw")).alias("ph"),
    )


def training_grid(scenes: DataFrame, window: int, stride: int) -> DataFrame:
    """scene_id, i, j, col0, row0, tile_idx, tile_name, gt of every full window; columns of windows from the west, each
    from the north. tile_idx counts them from 1, empty ones included. Row by row; nothing is shuffled."""
    sized = scenes.withColumns(
        {"nx": windows_along(F.col("width"), window, stride), "ny": windows_along(F.col("height"), window, stride)}
    ).where("nx > 0 AND ny > 0")
    columns = sized.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nx") - 1)))
    cells = columns.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ny") - 1)))
    cells = cells.withColumns(
        {
            "col0": F.col("i") * stride,
            "row0": F.col("j") * stride,
            "tile_idx": F.col("i") * F.col("ny") + F.col("j") + 1,
        }
    )
    return cells.select(
        "scene_id",
        "i",
        "j",
        "col0",
        "row0",
        "tile_idx",
        F.format_string("%s_%05d", clean_name(F.col("name")), F.col("tile_idx")).alias("tile_name"),
        tile_transform(F.col("col0"), F.col("row0")).alias("gt"),
    )


def prediction_stride(size: int, overlap: float) -> int:
    return max(1, int(size * (1 - overlap)))


def prediction_grid(scenes: DataFrame, size: int, overlap: float = 0.0) -> DataFrame:
    """scene_id, col0, row0, read_w, read_h: windows from every stride, read only as far as the scene goes."""
    stride = prediction_stride(size, overlap)
    columns = scenes.where("width > 0 AND height > 0").withColumn(
        "col0", F.explode(F.sequence(F.lit(0), F.col("width") - 1, F.lit(stride)))
    )
    cells = columns.withColumn("row0", F.explode(F.sequence(F.lit(0), F.col("height") - 1, F.lit(stride))))
    return cells.select(
        "scene_id",
        F.col("col0").cast("long").alias("col0"),
        F.col("row0").cast("long").alias("row0"),
        F.least(F.lit(size), F.col("width") - F.col("col0")).cast("long").alias("read_w"),
        F.least(F.lit(size), F.col("height") - F.col("row0")).cast("long").alias("read_h"),
    )


def prediction_tile_count(scenes: DataFrame, size: int, overlap: float = 0.0) -> DataFrame:
    stride = prediction_stride(size, overlap)
    return scenes.select(
        "scene_id", (F.ceil(F.col("width") / stride) * F.ceil(F.col("height") / stride)).alias("n_tiles")
    )


def storage_estimate(scenes: DataFrame, window: int, stride: int) -> DataFrame:
    """Bytes that clipping a scene may need, with 30 % to spare; at least one tile, as the estimate is an upper
    bound."""
    along = lambda size: F.greatest(F.lit(1), (F.floor((F.col(size) - window) / stride) + 1).cast("long"))
    tile = window * window * F.col("band_count") * 4 + window * window
    return scenes.select(
        "scene_id", F.floor(along("width") * along("height") * tile * 13 / 10).cast("long").alias("bytes")
    )
