"""Exact, reproducible splits of tiles into train, valid and test, and batches."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segjobs.functions.ranking import numbered, ranges, ranked
from segjobs.operators.validate import check_percentages

SEED = 42
SUBSETS = ("train", "valid", "test")
MAX_COMPAT = 5_000_000


def shuffle_key(seed: int | str, name: str = "tile_name") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(name)))


def shuffled(tiles: DataFrame, seed: int | str = SEED) -> DataFrame:
    """tiles (tile_name) with rank, their place from 1 in an order that depends on seed and name alone."""
    return ranked(tiles.withColumn("shuffle_key", shuffle_key(seed)), "shuffle_key", "tile_name").drop("shuffle_key")


def shuffled_as_list(spark: SparkSession, tiles: DataFrame, seed: int = SEED) -> DataFrame:
    """As shuffled(), but in the order of Python's own shuffle of the sorted names, for splits made that way before.

    The order is made on the driver, as one number a tile, for at most MAX_COMPAT tiles.
    """
    n = tiles.count()
    if n > MAX_COMPAT:
        raise ValueError(f"{n} tiles; this order is for at most {MAX_COMPAT}")
    order = list(range(n))
    random.Random(seed).shuffle(order)
    places = spark.createDataFrame(
        [(name + 1, place + 1) for place, name in enumerate(order)], "by_name bigint, rank bigint"
    )
    return ranked(tiles, "tile_name", name="by_name").join(places, "by_name").drop("by_name")


def split(
    tiles: DataFrame,
    train: int = 80,
    valid: int = 10,
    test: int = 10,
    seed: int | str = SEED,
    key: Sequence[str] = ("tile_name",),
) -> DataFrame:
    """tiles with subset; exact counts, halves rounded to even, and the rest to test. tiles are read once. key: the
    columns that tell rows apart; rows of one name are in order of the others, so that a subset ends at the same row in
    every run."""
    check_percentages(train, valid, test)
    order = "shuffle_key", "tile_name", *[c for c in key if c != "tile_name"]
    parts = ranges(tiles.withColumn("shuffle_key", shuffle_key(seed)), *order)
    if parts.isEmpty():
        raise ValueError("there are no tiles to split")
    share = lambda percent: F.bround(F.col("_all") * percent / 100)
    subset = F.when(F.col("rank") <= share(train), "train").when(
        F.col("rank") <= share(train) + share(valid), "valid"
    ).otherwise("test")
    return numbered(parts, *order, total="_all").withColumn("subset", subset).drop("shuffle_key", "_all")


def with_masks(split_tiles: DataFrame, masks: DataFrame, key: Sequence[str] = ("tile_name",)) -> DataFrame:
    """Split tiles with their masks (by the columns that tell rows apart), null where there is none."""
    return split_tiles.join(masks, list(key), "left")


def subset_counts(split_tiles: DataFrame) -> DataFrame:
    """subset and n of all three subsets, empty ones too."""
    counts = split_tiles.groupBy("subset").agg(F.count("*").alias("n"))
    every = split_tiles.sparkSession.createDataFrame([(s,) for s in SUBSETS], "subset string")
    return every.join(counts, "subset", "left").select("subset", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def batches(tiles: DataFrame, batch_size: int, shuffle_seed: str | None = None) -> DataFrame:
    """tiles with batch, from 0: runs of ``batch_size`` by name, or shuffled by seed (and epoch); the last is
    shorter."""
    placed = ranked(tiles, "tile_name") if shuffle_seed is None else shuffled(tiles, shuffle_seed)
    return placed.withColumn("batch", F.floor((F.col("rank") - 1) / batch_size).cast("long"))
