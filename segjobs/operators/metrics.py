"""Segmentation metrics: confusion counts by tile, batch and overall, and picks from epoch logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segjobs.functions.ranking import ranked

EPS = 1e-7
METRICS = ("iou", "f1", "precision", "recall", "pixel_accuracy")


def predicted(z: Column) -> Column:
    """Positive if the chance is over a half, strictly: if the logit is over 0. The chance itself is rounded to a half
    where the logit is tiny."""
    return (z > 0).cast("int")


def confusion(pixels: DataFrame, *keys: str) -> DataFrame:
    """keys, tp, fp, tn, fn of rows (p: predicted, t: true, both 0 or 1)."""
    count = lambda p, t: F.count_if((F.col("p") == p) & (F.col("t") == t))
    return pixels.groupBy(*keys).agg(
        count(1, 1).alias("tp"), count(1, 0).alias("fp"), count(0, 0).alias("tn"), count(0, 1).alias("fn")
    )


def tile_confusion(tiles: DataFrame) -> DataFrame:
    """tiles (z and mask arrays) with tp, fp, tn and fn; row by row."""
    both = F.zip_with("z", "mask", lambda z, t: predicted(z) * 2 + (t > 0).cast("int"))
    counted = tiles.withColumn("_both", both)
    count = lambda v: F.size(F.filter("_both", lambda x: x == v)).cast("long")
    return counted.withColumns({"tp": count(3), "fp": count(2), "tn": count(0), "fn": count(1)}).drop("_both")


def summed(counts: DataFrame, *keys: str) -> DataFrame:
    """keys and the sums of tp, fp, tn and fn: one row a key, however many rows share it."""
    return counts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "tn", "fn")])


def rates(counts: DataFrame) -> DataFrame:
    """counts (tp, fp, tn, fn) with METRICS; every divisor has EPS added, so an empty tile that is right has IoU 0."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return counts.withColumns(
        {
            "iou": tp / (tp + fp + fn + EPS),
            "f1": 2 * tp / (2 * tp + fp + fn + EPS),
            "precision": tp / (tp + fp + EPS),
            "recall": tp / (tp + fn + EPS),
            "pixel_accuracy": (tp + tn) / (tp + tn + fp + fn + EPS),
        }
    )


def tile_and_overall(counts: DataFrame, split: str = "split", tile: str = "tile_name") -> DataFrame:
    """Rates of each tile and, with a null tile, of each split from its summed counts: one pass with grouping sets."""
    sums = counts.groupingSets([[split, tile], [split]], split, tile).agg(
        *[F.sum(c).alias(c) for c in ("tp", "fp", "tn", "fn")], F.count("*").alias("n_tiles")
    )
    return rates(sums)


def batch_means(counts: DataFrame, batch: str = "batch") -> DataFrame:
    """IoU and F1 of each batch, and their plain mean over batches."""
    by_batch = rates(summed(counts, batch))
    return by_batch.agg(F.avg("iou").alias("val_iou"), F.avg("f1").alias("val_f1"), F.count("*").alias("n_batches"))


def evenly_spaced(tiles: DataFrame, n_samples: int) -> DataFrame:
    """Every so-manieth tile by name, at least ``n_samples`` of them if there are as many."""
    step = max(1, tiles.count() // n_samples)
    return ranked(tiles, "tile_name").where((F.col("rank") - 1) % step == 0).drop("rank")


def display(bands: Column) -> Column:
    """Three bands of 0 to 255 for show: the first three, or the first thrice; values are clipped and cut off.

    A NaN is shown as 255; numpy gives its cast to a byte no value.
    """
    byte = lambda band: F.transform(
        band,
        lambda v: F.when(F.isnan(v), F.lit(255)).otherwise(
            F.floor(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)) * 255).cast("int")
        ),
    )
    return F.when(F.size(bands) >= 3, F.array(*[byte(bands[k]) for k in range(3)])).otherwise(
        F.array(*[byte(bands[0])] * 3)
    )


def quality_class(rate: Column) -> Column:
    return F.when(rate >= 0.7, "good").when(rate >= 0.5, "fair").otherwise("poor")


def best_so_far(log: DataFrame, initial_best: float = -1.0) -> DataFrame:
    """log (run_id, epoch, val_iou) with is_best: over all earlier values of the run."""
    before = Window.partitionBy("run_id").orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    return log.withColumn(
        "is_best",
        F.col("val_iou") > F.greatest(
            F.coalesce(F.max("val_iou").over(before), F.lit(initial_best)), F.lit(initial_best)
        ),
    )


def best_epoch(log: DataFrame) -> DataFrame:
    """The first epoch of each run with its highest IoU to four decimals. Combined before the shuffle, unlike a
    window."""
    key = F.struct((-F.round("val_iou", 4)).alias("k"), "epoch")
    return log.groupBy("run_id").agg(F.min(key).alias("m")).select(
        "run_id", F.col("m.epoch").alias("epoch"), (-F.col("m.k")).alias("val_iou")
    )


def checkpoints(log: DataFrame, strategy: str = "best", every: int = 5) -> DataFrame:
    """Epochs that would be saved: those best so far, or every so-manieth of a run."""
    if strategy == "best":
        return best_so_far(log).where("is_best")
    if strategy != "every_n":
        raise ValueError(f"no such strategy: {strategy}")
    first = log.groupBy("run_id").agg(F.min("epoch").alias("_first"))
    return log.join(first, "run_id").where((F.col("epoch") - F.col("_first") + 1) % every == 0).drop("_first")
