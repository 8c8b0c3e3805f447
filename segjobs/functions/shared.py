"""The folder that all machines of a cluster share, tables written to it, and broadcasts of checked size."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, NumericType, TimestampType

#: A table is broadcast if it has at most so many rows and about so many bytes; else it is joined by a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 48 << 20

_folders: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_scratch: ContextVar[list[DataFrame] | None] = ContextVar("scratch", default=None)


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``, which every machine of the cluster sees.

    Where that setting is absent, a temporary folder takes its place on a single machine (tests); on a cluster, where
    executors would each write to their own disk, that is an error.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="segjobs-")
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/segjobs-{uuid.uuid4().hex}"


def stored(df: DataFrame, *partition_by: str) -> DataFrame:
    """df, written once as Parquet to the shared folder and read again: its lineage ends there."""
    path = shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path, partitionBy=list(partition_by) or None)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _folders[out] = path
    if (written := _scratch.get()) is not None:
        written.append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables from stored() that nothing reads any more."""
    for df in tables:
        path = _folders.pop(df, None)
        if path:
            context = df.sparkSession.sparkContext
            folder = context._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Delete the tables that stored() writes within, on leaving, also after an error: for work whose results are
    written elsewhere by then. Frames that read such a table cannot be used afterwards.

    Gives a function that keeps one table of stored(), for the scratch around this one if there is one.
    """
    written: list[DataFrame] = []
    around = _scratch.get()
    token = _scratch.set(written)

    def keep(df: DataFrame) -> DataFrame:
        written[:] = [t for t in written if t is not df]
        if around is not None:
            around.append(df)
        return df

    try:
        yield keep
    finally:
        _scratch.reset(token)
        discard(*written)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df, marked for broadcast if it has at most so many rows and bytes, else as it is.

    Numbers count 16 bytes each; rows of other types are measured by their JSON. No more than ``rows`` are looked at.
    """
    flat = (NumericType, BooleanType, DateType, TimestampType)
    if all(isinstance(f.dataType, flat) for f in df.schema.fields):
        width = F.lit(16 * len(df.columns))
    else:
        width = F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    n, total = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and total <= size else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
