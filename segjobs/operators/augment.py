"""Augmentation of tiles: every selected method on the image and the mask of every tile."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

Method = tuple[str, Callable[[np.ndarray], np.ndarray]]

#: Name: (suffix, function of an array whose last two axes are rows and columns). "Mirror" is a transpose.
METHODS: dict[str, Method] = {
    "Original": ("original", lambda m: m),
    "Rotate 90": ("rot90", lambda m: np.rot90(m, 1, (-2, -1))),
    "Rotate 180": ("rot180", lambda m: np.rot90(m, 2, (-2, -1))),
    "Rotate 270": ("rot270", lambda m: np.rot90(m, 3, (-2, -1))),
    "Mirror": ("mirror", lambda m: np.swapaxes(m, -2, -1)),
    "Flip H": ("fliph", lambda m: m[..., ::-1]),
    "Flip V": ("flipv", lambda m: m[..., ::-1, :]),
}


def flipped_transform(gt: Column, size: Column, method: Column) -> Column:
    """The geotransform after a method: flips move the origin and turn an axis; others leave it."""
    pick = lambda **new: F.struct(
        *[(new[k] if k in new else gt[k]).alias(k) for k in ("x0", "pw", "rx", "y0", "ry", "ph")]
    )
    zero = F.lit(0.0)
    flip_h = pick(x0=gt["x0"] + size * gt["pw"], pw=-gt["pw"], rx=zero, ry=zero)
    flip_v = pick(rx=zero, y0=gt["y0"] + size * gt["ph"], ry=zero, ph=-gt["ph"])
    return F.when(method == "Flip H", flip_h).when(method == "Flip V", flip_v).otherwise(gt)


#: Tiles of one size are turned together, up to so many pixels a band.
AT_ONCE = 1 << 18


def _turned(column: pa.Array, size: int, turn: Callable[[np.ndarray], np.ndarray]) -> pa.Array:
    """A column of row-major arrays, or of lists of them (bands), with each array turned; null rows stay null."""
    whole = column.drop_null()
    nested = pa.types.is_list(column.type.value_type)
    arrays = whole.flatten() if nested else whole
    if arrays.null_count or pc.any(pc.not_equal(pc.list_value_length(arrays), size * size)).as_py():
        raise ValueError(f"a tile of size {size} has an array of another length")
    flat = arrays.flatten()
    values = np.array(flat.to_pylist(), object) if flat.null_count else flat.to_numpy(zero_copy_only=False)
    made = np.ascontiguousarray(turn(values.reshape(-1, size, size))).ravel()
    made = pa.array(made.tolist(), flat.type) if made.dtype == object else pa.array(made).cast(flat.type)
    ends = np.arange(len(arrays) + 1, dtype=np.int32) * (size * size)
    out = pa.ListArray.from_arrays(pa.array(ends), made, type=arrays.type)
    if nested:
        ends = np.append(0, np.cumsum(pc.list_value_length(whole).to_numpy(zero_copy_only=False))).astype(np.int32)
        out = pa.ListArray.from_arrays(pa.array(ends), out, type=column.type)
    if column.null_count:
        there = column.is_valid().to_numpy(zero_copy_only=False)
        out = out.take(pa.array(np.cumsum(there) - 1, mask=~there))
    return out


def augmented(tiles: DataFrame, methods: Iterable[str], registry: dict[str, Method] | None = None) -> DataFrame:
    """tiles once for each method, with tile_name ``<stem>_<suffix>`` and method; unknown methods are left out.

    tiles: tile_name, size, bands (row-major arrays), and possibly mask, gt and more columns. No shuffle: rows multiply
    in place, neighbours of one size together, ``AT_ONCE`` pixels or one tile at a time. A null mask stays null.
    """
    registry = METHODS if registry is None else registry
    chosen = {m: registry[m] for m in methods if m in registry}
    names = tiles.columns

    def rows(found):
        for batch in found:
            sizes = batch.column(names.index("size")).to_numpy(zero_copy_only=False)
            i = 0
            while i < batch.num_rows:
                size = int(sizes[i])
                most = max(1, AT_ONCE // max(1, size * size))
                part = batch.slice(i, int(np.argmax(np.append(sizes[i : i + most] != size, True))))
                i += part.num_rows
                stems = [name.removesuffix(".tif") for name in part.column(names.index("tile_name")).to_pylist()]
                for method, (suffix, turn) in chosen.items():
                    arrays = list(part.columns)
                    for c in ("bands", "mask"):
                        if c in names:
                            arrays[names.index(c)] = _turned(part.column(names.index(c)), size, turn)
                    arrays[names.index("tile_name")] = pa.array([f"{stem}_{suffix}" for stem in stems])
                    yield pa.RecordBatch.from_arrays([*arrays, pa.array([method] * len(stems))], [*names, "method"])

    out = tiles.mapInArrow(rows, StructType([*tiles.schema.fields, StructField("method", StringType())]))
    return out.withColumn(
        "gt", flipped_transform(F.col("gt"), F.col("size"), F.col("method"))
    ) if "gt" in names else out
