"""Segmentation losses over batches of pixels: rows (batch, z: logit, t: 0 or 1), or sums by tile."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SMOOTH = 1.0


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def cross_entropy(z: Column, t: Column) -> Column:
    """Binary cross-entropy of one pixel from its logit, safe for large ones."""
    return F.greatest(z, F.lit(0.0)) - z * t + F.log1p(F.exp(-F.abs(z)))


def batch_losses(pixels: DataFrame, *keys: str) -> DataFrame:
    """keys, bce, dice and bce_dice. One aggregate: sums are combined before the shuffle."""
    p, t = sigmoid(F.col("z")), F.col("t").cast("double")
    sums = pixels.groupBy(*keys).agg(
        F.avg(cross_entropy(F.col("z"), t)).alias("bce"),
        F.sum(p * t).alias("_pt"),
        F.sum(p).alias("_p"),
        F.sum(t).alias("_t"),
    )
    dice = 1 - (2 * F.col("_pt") + SMOOTH) / (F.col("_p") + F.col("_t") + SMOOTH)
    return sums.select(*keys, "bce", dice.alias("dice"), (0.5 * F.col("bce") + 0.5 * dice).alias("bce_dice"))


SUMS = ("n", "ce", "pt", "p", "t", "tp", "fp", "tn", "fn")


def tile_sums(tiles: DataFrame) -> DataFrame:
    """tile_name and, over its pixels, their number, the sums of cross-entropies, of chance times truth, of chances and
    of truths, and tp, fp, tn, fn: whole arrays (z and mask) at a time, a row a tile.

    A null array counts as empty; z and mask of different lengths are an error. A null logit counts for its truth only.
    """

    def rows(batches):
        for batch in batches:
            z, mask = (batch.column(k) for k in (1, 2))
            size, other = (
                np.nan_to_num(x.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64) for x in (z, mask)
            )
            if (size != other).any():
                raise ValueError("a tile's logits and mask differ in length")
            tile = np.repeat(np.arange(len(size)), size)
            flat = z.flatten()
            there = flat.is_valid().to_numpy(zero_copy_only=False)
            v = np.where(there, flat.to_numpy(zero_copy_only=False), 0).astype(np.float64)
            t = (mask.flatten().to_numpy(zero_copy_only=False) > 0).astype(np.float64)
            p = 1 / (1 + np.exp(-v))
            on, off = (v > 0) | np.isnan(v), there & (v <= 0)  # a NaN is over 0, as in Spark
            each = (
                there,
                there * (np.maximum(v, 0) - v * t + np.log1p(np.exp(-np.abs(v)))),
                there * p * t,
                there * p,
                t,
                on & (t > 0),
                on & (t == 0),
                off & (t == 0),
                off & (t > 0),
            )
            total = [np.bincount(tile, x, len(size)) for x in each]
            types = [pa.int64(), *[pa.float64()] * 4, *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *(
                        pa.array(x.astype(np.int64) if k == pa.int64() else x, k)
                        for x, k in zip(total, types, strict=True)
                    ),
                ],
                ["tile_name", *SUMS],
            )

    schema = "tile_name string, n bigint, ce double, pt double, p double, t double, tp bigint, fp bigint, tn bigint, fn bigint"
    return tiles.select("tile_name", "z", "mask").mapInArrow(rows, schema)


def name_sums(sums: DataFrame) -> DataFrame:
    """tile_sums() by name: rows that share one are one tile."""
    return sums.groupBy("tile_name").agg(*[F.sum(c).alias(c) for c in SUMS])


def summed_losses(sums: DataFrame, *keys: str) -> DataFrame:
    """batch_losses() from tile_sums() with keys."""
    total = sums.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "ce", "pt", "p", "t")])
    bce, dice = F.col("ce") / F.col("n"), 1 - (2 * F.col("pt") + SMOOTH) / (F.col("p") + F.col("t") + SMOOTH)
    return total.select(*keys, bce.alias("bce"), dice.alias("dice"), (0.5 * bce + 0.5 * dice).alias("bce_dice"))


def epoch_loss(losses: DataFrame, loss: str = "bce_dice") -> DataFrame:
    """The plain mean over batches, whatever their sizes."""
    return losses.agg(F.avg(loss).alias("loss"), F.count("*").alias("n_batches"))
