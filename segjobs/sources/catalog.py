"""Versioned stage outputs: ``<root>/<prefix>_dataset/<stage>/v<N>`` with a table and ``<stage>_info.json``."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STAGES = ("clipping", "splitting", "augmented")
MAX_TRIES = 100


def _listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any file system that Spark reads; none if it is missing."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def stage_folder(root: str, prefix: str, stage: str) -> str:
    return f"{root.rstrip('/')}/{prefix}_dataset/{stage}"


def versions(spark: SparkSession, root: str, prefix: str, stage: str) -> list[int]:
    """Numbers of all ``v<number>`` folders, ascending; other names are ignored."""
    return sorted(
        int(m[1]) for name in _listed(spark, stage_folder(root, prefix, stage)) if (m := re.fullmatch(r"v(\d+)", name))
    )


def next_version(spark: SparkSession, root: str, prefix: str, stage: str) -> int:
    """One more than the largest; gaps are not filled."""
    return max(versions(spark, root, prefix, stage), default=0) + 1


def _moved(spark: SparkSession, source: str, target: str, mark: str) -> bool:
    """Whether the folder source, which holds a file of the name mark, became target; False if target was there before.

    Stores rename a folder at once. Where one moves it into a target that is there already, mark tells, and it comes
    back out.
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(source).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(path(target)):
        return False
    fs.rename(path(source), path(target))
    if fs.exists(path(f"{target}/{mark}")):
        return True
    name = source.rstrip("/").rsplit("/", 1)[-1]
    if fs.exists(path(f"{target}/{name}")):
        fs.rename(path(f"{target}/{name}"), path(source))
    return False


def write_version(
    df: DataFrame, root: str, prefix: str, stage: str, info: dict, partition_by: str | None = None
) -> int:
    """Write df and its info (made a row of JSON, with a time stamp) as a new version; its number.

    Both are written to a folder of their own first, which then takes the next free number by one rename: a version is
    there with its table and info or not at all, and writers that finish at once get different numbers.
    """
    spark, mark = df.sparkSession, f"_{uuid.uuid4().hex}"
    folder = stage_folder(root, prefix, stage)
    own = f"{folder}/_writing{mark}"
    df.write.mode("errorifexists").parquet(f"{own}/table", partitionBy=[partition_by] if partition_by else None)
    row = spark.range(1).select(
        F.current_timestamp().cast("string").alias("created"), *[F.lit(v).alias(k) for k, v in info.items()]
    )
    row.coalesce(1).write.mode("errorifexists").json(f"{own}/{stage}_info.json")
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(f"{own}/{mark}")
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place, False).close()
    for _ in range(MAX_TRIES):
        number = next_version(spark, root, prefix, stage)
        if _moved(spark, own, f"{folder}/v{number}", mark):
            return number
    raise RuntimeError(f"no version of {folder} was free in {MAX_TRIES} tries")


def read_version(spark: SparkSession, root: str, prefix: str, stage: str, number: int) -> DataFrame:
    return spark.read.parquet(f"{stage_folder(root, prefix, stage)}/v{number}/table")


def scan_versions(spark: SparkSession, root: str, prefix: str, stage: str) -> DataFrame:
    """version and info (JSON text; null where the info is missing), by number: one read over the infos of all
    versions."""
    folder = stage_folder(root, prefix, stage)
    numbers = versions(spark, root, prefix, stage)
    listed = spark.createDataFrame([(n,) for n in numbers], "version int")
    with_info = [
        f"{folder}/v{n}/{stage}_info.json" for n in numbers if _exists(spark, f"{folder}/v{n}/{stage}_info.json")
    ]
    if not with_info:
        return listed.select("version", F.lit(None).cast("string").alias("info")).orderBy("version")
    texts = spark.read.text(with_info).select(
        F.regexp_extract(F.col("_metadata.file_path"), r"/v(\d+)/[^/]*_info\.json/", 1).cast("int").alias("version"),
        "value",
    )
    infos = texts.groupBy("version").agg(F.first("value").alias("info"))
    return listed.join(infos, "version", "left").orderBy("version")


def dataset_summary(augmented: DataFrame, clipping: DataFrame) -> DataFrame:
    """Augmented versions (version, based_on_clipping_version, n_train, n_valid, n_test) with the tile size and bands of
    their clipping version."""
    own = clipping.select(F.col("version").alias("based_on_clipping_version"), "window_size", "band_count")
    return augmented.join(own, "based_on_clipping_version", "left").select(
        "version", "based_on_clipping_version", "window_size", "band_count", "n_train", "n_valid", "n_test"
    )
