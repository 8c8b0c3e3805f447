"""Result tables in the form in which they are handed on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segjobs.operators.clean import area
from segjobs.operators.metrics import METRICS


def _six(x: Column) -> Column:
    """Six decimals; halves, which doubles seldom hold exactly, go up."""
    return F.format_string("%.6f", F.round(x + 1e-12, 6))


def metric_lines(rates: DataFrame) -> DataFrame:
    """filename and the metrics with six decimals."""
    return rates.select(F.col("tile_name").alias("filename"), *[_six(F.col(m)).alias(m) for m in METRICS])


def write_metrics(rates: DataFrame, path: str) -> None:
    metric_lines(rates).write.option("header", True).csv(path)


def epoch_lines(log: DataFrame) -> DataFrame:
    """The epoch log's columns as they are written: six decimals."""
    return log.select(
        "run_id",
        F.col("epoch").alias("Epoch"),
        *[
            _six(F.col(c)).alias(name)
            for c, name in (
                ("train_loss", "Train Loss"), ("val_loss", "Val Loss"), ("val_iou", "Val IoU"), ("val_f1", "Val F1")
            )
        ],
    )


def append_epochs(log: DataFrame, path: str) -> None:
    epoch_lines(log).write.mode("append").option("header", True).csv(path)


def raster(mask: DataFrame) -> DataFrame:
    """Pixels with value 255 where the mask is 1, else 0, which stands for no data."""
    return mask.select("scene_id", "y", "x", F.when(F.col("mask") == 1, 255).otherwise(0).cast("short").alias("value"))


def raster_blocks(mask: DataFrame, block: int) -> DataFrame:
    """The raster in blocks: scene_id, block_y, block_x, places (row * block + column, ascending) and values there.

    A missing pixel has no place and moves no other.
    """
    keyed = raster(mask).withColumns({"block_y": F.floor(F.col("y") / block), "block_x": F.floor(F.col("x") / block)})
    place = ((F.col("y") - F.col("block_y") * block) * block + F.col("x") - F.col("block_x") * block).cast("int")
    return keyed.groupBy("scene_id", "block_y", "block_x").agg(
        F.array_sort(F.collect_list(F.struct(place.alias("place"), "value"))).alias("v")
    ).select("scene_id", "block_y", "block_x", F.col("v.place").alias("places"), F.col("v.value").alias("values"))


def raster_pixels(blocks: DataFrame, block: int) -> DataFrame:
    """The pixels of raster_blocks(): scene_id, y, x, value."""
    rows = blocks.select("scene_id", "block_y", "block_x", F.explode(F.arrays_zip("places", "values")).alias("v"))
    return rows.select(
        "scene_id",
        (F.col("block_y") * block + F.floor(F.col("v.places") / block)).alias("y"),
        (F.col("block_x") * block + F.col("v.places") % block).alias("x"),
        F.col("v.values").alias("value"),
    )


def tile_masks(predictions: DataFrame, tiles: DataFrame, key: Sequence[str] = ("tile_name",)) -> DataFrame:
    """Predicted masks (0 and 255) with the geotransform and CRS of the image tile of the same name, or key."""
    values = F.transform("predicted", lambda v: F.when(v == 1, 255).otherwise(0).cast("short"))
    return predictions.join(tiles.select(*key, "gt", "crs"), list(key)).select(
        "tile_name", values.alias("mask"), "gt", "crs"
    )


def multipolygons(polygons: DataFrame) -> DataFrame:
    """Polygons as multipolygons with their area; a row of single rings (column rings) becomes one part."""
    parts = F.array("rings") if "rings" in polygons.columns else F.col("parts")
    own = polygons.withColumn("parts", parts).drop("rings")
    return own.withColumns({"geom_type": F.lit("MultiPolygon"), "area": area(F.col("parts"))})


def write_prediction(
    mask: DataFrame, polygons: DataFrame | None, path: str, outputs: str = "both", block: int = 256
) -> None:
    """The raster, the polygons or both, below path."""
    if outputs not in ("raster", "vector", "both"):
        raise ValueError(f"no such output: {outputs}")
    if outputs != "vector":
        raster_blocks(mask, block).write.parquet(f"{path}/raster")
    if outputs != "raster":
        multipolygons(polygons).write.parquet(f"{path}/vector")
