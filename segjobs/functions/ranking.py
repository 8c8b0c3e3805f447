"""Exact global ranks without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segjobs.functions.shared import small, stored


def ranges(df: DataFrame, *order: str | Column) -> DataFrame:
    """df in ranges of the order, one a task, with _part. They are written, so that they stay as they are if tasks
    rerun."""
    return stored(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))


def numbered(parts: DataFrame, *order: str | Column, name: str = "rank", total: str | None = None) -> DataFrame:
    """ranges() with the rank from 1 of each row, and with the number of all rows as total: from one count a range."""
    counts = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select(
        "_part",
        (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"),
        *([F.sum("_n").over(Window.partitionBy(F.lit(0))).alias(total)] if total else []),
    )
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.join(small(before), "_part").withColumn(name, (F.col("_before") + within).cast("long")).drop(
        "_part", "_before"
    )


def ranked(df: DataFrame, *order: str | Column, name: str = "rank") -> DataFrame:
    """df with the rank from 1 of each row in the given order; equal rows get different ranks.

    Ranges of the order go to tasks; the number of rows before a range comes from one count for each.
    """
    return numbered(ranges(df, *order), *order, name=name)
