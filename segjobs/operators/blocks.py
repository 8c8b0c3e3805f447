"""Scenes as square blocks of pixels, and windows cut from them with an exchange of block edges.

A pixel table becomes blocks in one shuffle of its rows. A window belongs to the block in which it begins, so a block
needs, besides its own pixels, the edges of the three blocks to its right and below that its windows reach into: what
travels is the pixels once and these edges, not a copy of each pixel for every window over it. Blocks written by
write_blocks() are laid out by scene and row of blocks, so that a job that wants few windows reads few files.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segjobs.functions import nested
from segjobs.functions.shared import small
from segjobs.operators.grid import clean_name, prediction_stride, windows_along

_BLOCKS = "scene_id bigint, by bigint, bx bigint, height int, width int, bands array<array<double>>"
_TILES = "scene_id bigint, col0 bigint, row0 bigint, read_w bigint, read_h bigint, bands array<array<double>>"


def arrays(values: np.ndarray, missing: np.ndarray | None = None) -> pa.Array:
    """(tiles x bands x pixels) numbers as a list of bands for each tile; null where missing."""
    n, bands, size = values.shape
    flat = pa.array(values.ravel(), mask=None if missing is None or not missing.any() else missing.ravel())
    each = pa.ListArray.from_arrays(pa.array(np.arange(n * bands + 1, dtype=np.int32) * size), flat)
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), each)


def placed(lists: pa.Array, size: int, nodata: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(values, missing), each tiles x bands x size, of lists of structs: the place of a pixel, then its bands.

    A place without a row, or whose band is null, is missing, or nodata if that is given. Two rows of one place are an
    error.
    """
    n, rows = len(lists), lists.flatten()
    at = np.repeat(np.arange(n), nested.sizes(lists)) * size + rows.field(0).to_numpy(zero_copy_only=False).astype(
        np.int64
    )
    if len(at) and np.bincount(at).max() > 1:
        raise ValueError("two rows have the same pixel")
    bands = rows.type.num_fields - 1
    values, missing = np.zeros((bands, n * size)), np.ones((bands, n * size), bool)
    for k in range(bands):
        column = rows.field(k + 1)
        there = column.is_valid().to_numpy(zero_copy_only=False)
        values[k, at[there]] = column.to_numpy(zero_copy_only=False)[there]
        missing[k, at[there]] = False
    if nodata is not None:
        values[missing] = nodata
        missing[:] = False
    shaped = lambda x: np.ascontiguousarray(x.reshape(bands, n, size).swapaxes(0, 1))
    return shaped(values), shaped(missing)


def parts_of(batch: pa.RecordBatch, pixels: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about a million pixels, so that memory does not grow with rows of a batch: a slice is held
    as numbers, as what is missing, and as the lists made of both."""
    few = max(1, (1 << 20) // max(pixels, 1))
    for i in range(0, batch.num_rows, few):
        yield batch.slice(i, few)


def blocks_of(
    pixels: DataFrame, scenes: DataFrame, block: int, bands: list[str], nodata: float | None = None
) -> DataFrame:
    """scene_id, by, bx, height, width, bands (row-major) of pixels (scene_id, y, x and bands): blocks of block x block,
    less at a scene's right and lower edge. Missing pixels are null, or nodata; two rows of one pixel are an error;
    pixels outside their scene are left out. One shuffle, a row a pixel.
    """
    own = scenes.select("scene_id", F.col("width").alias("_w"), F.col("height").alias("_h"))
    inside = pixels.join(small(own), "scene_id").where("y >= 0 AND x >= 0 AND y < _h AND x < _w")
    place = (F.col("y") % block * block + F.col("x") % block).cast("int")
    keyed = inside.select(
        "scene_id",
        F.floor(F.col("y") / block).alias("by"),
        F.floor(F.col("x") / block).alias("bx"),
        "_w",
        "_h",
        F.struct(place.alias("p"), *[F.col(b).cast("double").alias(b) for b in bands]).alias("v"),
    )
    size = lambda n, k: F.least(F.lit(block), F.first(n) - F.col(k) * block).cast("int")
    grouped = keyed.groupBy("scene_id", "by", "bx").agg(
        size("_h", "by").alias("height"), size("_w", "bx").alias("width"), F.collect_list("v").alias("v")
    )

    def rows(batches):
        for whole in batches:
            for batch in parts_of(whole, block * block * len(bands)):
                values, missing = placed(batch.column(5), block * block, nodata)
                heights, widths = (batch.column(k).to_pylist() for k in (3, 4))
                flat, gone, sizes = [], [], []
                for k, (h, w) in enumerate(zip(heights, widths, strict=True)):
                    cut = lambda x: x[k].reshape(-1, block, block)[:, :h, :w].reshape(  # noqa: E731, B023
                        len(bands), -1
                    )
                    flat.append(cut(values).ravel())
                    gone.append(cut(missing).ravel())
                    sizes += [h * w] * len(bands)
                mask = np.concatenate(gone) if gone else np.empty(0, bool)
                data = pa.array(np.concatenate(flat) if flat else np.empty(0), mask=mask)
                each = pa.ListArray.from_arrays(nested.offsets(np.array(sizes, np.int64)), data)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(heights) + 1, dtype=np.int32) * len(bands)), each
                )
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k) for k in range(5)), lists], ["scene_id", "by", "bx", "height", "width", "bands"]
                )

    return grouped.select(
        F.col("scene_id").cast("long").alias("scene_id"),
        F.col("by").cast("long").alias("by"),
        F.col("bx").cast("long").alias("bx"),
        "height",
        "width",
        "v",
    ).mapInArrow(rows, _BLOCKS)


def write_blocks(blocks: DataFrame, path: str) -> None:
    """Blocks as files by scene and row of blocks."""
    blocks.repartition("scene_id", "by").write.partitionBy("scene_id", "by").parquet(path)


def read_blocks(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """Blocks of write_blocks(); of those alone that wanted (scene_id, by, bx) names, if given. Its scenes and rows
    prune the folders that are read, while the job runs."""
    found = spark.read.parquet(path).select(
        F.col("scene_id").cast("long").alias("scene_id"),
        F.col("by").cast("long").alias("by"),
        "bx",
        "height",
        "width",
        "bands",
    )
    if wanted is None:
        return found
    # A filter on the broadcast side is what makes Spark prune by it.
    names = wanted.select(
        F.col("scene_id").cast("long").alias("scene_id"),
        F.col("by").cast("long").alias("by"),
        F.col("bx").cast("long").alias("bx"),
    ).where("by >= 0").distinct()
    return found.join(small(names), ["scene_id", "by", "bx"], "left_semi")


def block_for(window: int, stride: int) -> int:
    """A block size for windows: a multiple of the stride, about four windows wide."""
    return stride * -(-max(4 * window, stride) // stride)


def blocks_under(windows: DataFrame, block: int, window: int) -> DataFrame:
    """scene_id, by, bx of the blocks that windows (scene_id, row0, col0) reach into."""
    along = lambda c: F.explode(
        F.sequence(F.floor(F.col(c) / block).cast("long"), F.floor((F.col(c) + (window - 1)) / block).cast("long"))
    )
    return windows.select("scene_id", along("row0").alias("by"), "col0").select(
        "scene_id", "by", along("col0").alias("bx")
    ).distinct()


def _edges(blocks: DataFrame, block: int, reach: int) -> DataFrame:
    """The pieces of blocks that those to their left, above, and above to their left need: home by and bx, place,
    bands."""

    def rows(batches):
        for whole in batches:
            for batch in parts_of(whole, block * block):
                scene, by, bx, height, width = (batch.column(k).to_pylist() for k in range(5))
                out: list[tuple] = []
                for k in range(batch.num_rows):
                    bands = batch.column(5)[k].values
                    flat = bands.flatten()
                    there = flat.is_valid().to_numpy(zero_copy_only=False).reshape(len(bands), height[k], width[k])
                    data = flat.to_numpy(zero_copy_only=False).reshape(there.shape)
                    for dy, dx in ((0, 1), (1, 0), (1, 1)):
                        if by[k] < dy or bx[k] < dx:
                            continue
                        h, w = min(height[k], reach) if dy else height[k], min(width[k], reach) if dx else width[k]
                        out.append(
                            (scene[k], by[k] - dy, bx[k] - dx, by[k], bx[k], h, w, data[:, :h, :w], there[:, :h, :w])
                        )
                if not out:
                    continue
                n_bands = out[0][7].shape[0]
                data, gone = np.concatenate([o[7].ravel() for o in out]), np.concatenate([~o[8].ravel() for o in out])
                each = pa.ListArray.from_arrays(
                    nested.offsets(np.repeat([o[5] * o[6] for o in out], n_bands)), pa.array(data, mask=gone)
                )
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * n_bands), each)
                types = [pa.int64()] * 5 + [pa.int32()] * 2
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([o[j] for o in out], t) for j, t in enumerate(types)), lists],
                    ["scene_id", "hy", "hx", "by", "bx", "height", "width", "bands"],
                )

    schema = "scene_id bigint, hy bigint, hx bigint, by bigint, bx bigint, height int, width int, bands array<array<double>>"
    return blocks.select("scene_id", "by", "bx", "height", "width", "bands").mapInArrow(rows, schema)


def windows_of(
    blocks: DataFrame,
    scenes: DataFrame,
    block: int,
    window: int,
    stride: int,
    full: bool,
    wanted: DataFrame | None = None,
) -> DataFrame:
    """scene_id, col0, row0, read_w, read_h, bands (window x window, row-major) of the windows at every multiple of the
    stride; with full, of those alone that lie within the scene, else 0 where one reaches over the scene's edge. wanted
    (scene_id, col0, row0) names the windows to cut, all if it is absent. Missing pixels stay null.

    block: the size of blocks, a multiple of the stride and no less than a window reaches beyond it.
    """
    reach = max(window - stride, 0)
    if block % stride or reach > block:
        raise ValueError(f"blocks of {block} do not suit windows of {window} at every {stride}")
    own = blocks.select(
        "scene_id", F.col("by").alias("hy"), F.col("bx").alias("hx"), "by", "bx", "height", "width", "bands"
    )
    pieces = own.unionByName(_edges(blocks, block, reach)) if reach else own
    grouped = pieces.groupBy("scene_id", "hy", "hx").agg(
        F.collect_list(F.struct("by", "bx", "height", "width", "bands")).alias("pieces")
    )
    homes = grouped.join(
        small(
            scenes.select(
                F.col("scene_id").cast("long").alias("scene_id"),
                F.col("width").alias("_w"),
                F.col("height").alias("_h"),
            )
        ),
        "scene_id",
    )
    if wanted is None:
        homes = homes.withColumn("starts", F.lit(None).cast("array<bigint>"))
    else:
        of = lambda c: F.floor(F.col(c) / block).cast("long")
        start = (F.col("row0") % block * block + F.col("col0") % block).cast("long")
        starts = wanted.groupBy(
            F.col("scene_id").cast("long").alias("scene_id"), of("row0").alias("hy"), of("col0").alias("hx")
        ).agg(F.collect_set(start).alias("starts"))
        homes = homes.join(starts, ["scene_id", "hy", "hx"])

    def rows(batches):
        for whole in batches:
            for batch in parts_of(whole, (block + reach) ** 2):
                scene, hy, hx, width, height = (batch.column(k).to_pylist() for k in (0, 1, 2, 4, 5))
                for k in range(batch.num_rows):
                    yield from cut(
                        scene[k],
                        hy[k] * block,
                        hx[k] * block,
                        batch.column(3)[k].values,
                        width[k],
                        height[k],
                        batch.column(6)[k].as_py(),
                    )

    def cut(scene, y0, x0, pieces, width, height, starts):
        side = block + max(window, stride)
        names = [f.name for f in pieces.type]
        bands = pieces.field(names.index("bands"))
        n_bands = len(bands[0].values)
        image, gone = np.zeros((n_bands, side, side)), np.ones((n_bands, side, side), bool)
        gone[:, max(height - y0, 0) :], gone[:, :, max(width - x0, 0) :] = False, False  # zeros beyond the scene
        for j in range(len(pieces)):
            by, bx, h, w = (pieces.field(names.index(c))[j].as_py() for c in ("by", "bx", "height", "width"))
            y, x, flat = by * block - y0, bx * block - x0, bands[j].values.flatten()
            image[:, y : y + h, x : x + w] = flat.to_numpy(zero_copy_only=False).reshape(n_bands, h, w)
            gone[:, y : y + h, x : x + w] = ~flat.is_valid().to_numpy(zero_copy_only=False).reshape(n_bands, h, w)
        if starts is None:
            y, x = (
                v.ravel() for v in np.meshgrid(np.arange(0, block, stride), np.arange(0, block, stride), indexing="ij")
            )
        else:
            y, x = np.divmod(np.array(sorted(starts), np.int64), block)
        fits = (y0 + y + window <= height) & (x0 + x + window <= width) if full else (y0 + y < height) & (
            x0 + x < width
        )
        y, x = y[fits], x[fits]
        few = max(1, (4 << 20) // (window * window * n_bands))
        for i in range(0, len(y), few):
            corners = list(zip(y[i : i + few].tolist(), x[i : i + few].tolist(), strict=True))
            values, missing = (
                np.stack([v[:, a : a + window, b : b + window].reshape(n_bands, -1) for a, b in corners])
                for v in (image, gone)
            )
            row0, col0 = y0 + y[i : i + few], x0 + x[i : i + few]
            columns = [
                np.full(len(row0), scene),
                col0,
                row0,
                np.minimum(window, width - col0),
                np.minimum(window, height - row0),
            ]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in columns), arrays(values, missing)],
                ["scene_id", "col0", "row0", "read_w", "read_h", "bands"],
            )

    return homes.select("scene_id", "hy", "hx", "pieces", "_w", "_h", "starts").mapInArrow(rows, _TILES)


def training_tiles(
    blocks: DataFrame, scenes: DataFrame, block: int, window: int, stride: int, wanted: DataFrame | None = None
) -> DataFrame:
    """scene_id, tile_idx, tile_name, size, bands of full windows, as clip.tiles_of() has them; wanted: scene_id, col0,
    row0."""
    found = windows_of(blocks, scenes, block, window, stride, True, wanted)
    sized = small(
        scenes.select(
            F.col("scene_id").cast("long").alias("scene_id"),
            "name",
            windows_along(F.col("height"), window, stride).alias("ny"),
        )
    )
    named = found.join(sized, "scene_id").withColumn(
        "tile_idx", (F.col("col0") / stride * F.col("ny") + F.col("row0") / stride + 1).cast("long")
    )
    return named.select(
        "scene_id",
        "tile_idx",
        F.format_string("%s_%05d", clean_name(F.col("name")), F.col("tile_idx")).alias("tile_name"),
        F.lit(window).alias("size"),
        "bands",
    )


def prediction_tiles(blocks: DataFrame, scenes: DataFrame, block: int, size: int, overlap: float) -> DataFrame:
    """scene_id, col0, row0, size, read_w, read_h, bands of prediction windows, as score.prediction_tiles() has them."""
    found = windows_of(blocks, scenes, block, size, prediction_stride(size, overlap), False)
    return found.select("scene_id", "col0", "row0", F.lit(size).alias("size"), "read_w", "read_h", "bands")
