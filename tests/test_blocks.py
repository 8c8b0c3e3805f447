"""Scenes in blocks: the same windows as from single pixels, with missing pixels, edges and pruned reads."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from segjobs.functions.shared import shared_folder
from segjobs.operators import blocks, clip, grid, jobs, score
from segjobs.sources import fixtures as fx

PIXELS = "scene_id bigint, y bigint, x bigint, b1 double, b2 double, node int"


@pytest.fixture(scope="module")
def scene(spark):
    """Two scenes of uneven sizes, some pixels missing, a whole region of one too; a null band; a pixel outside."""
    r = np.random.default_rng(4)
    sizes, rows, image = {1: (37, 23), 2: (9, 50)}, [], {}
    for s, (w, h) in sizes.items():
        values = np.round(r.random((2, h, w)) * 100, 3)
        gone = r.random((h, w)) < 0.1
        gone[: h // 3, : w // 3] = True
        values[:, gone] = np.nan
        values[1, -1, -1] = np.nan
        image[s] = values
        rows += [
            (s, y, x, float(values[0, y, x]), None if np.isnan(values[1, y, x]) else float(values[1, y, x]), 1)
            for y in range(h)
            for x in range(w)
            if not gone[y, x] and not np.isnan(values[0, y, x])
        ]
    rows.append((1, 0, 99, 1.0, 1.0, 1))
    scenes = spark.createDataFrame(
        [(s, f"scene {s}", w, h, 2) for s, (w, h) in sizes.items()],
        "scene_id bigint, name string, width int, height int, band_count int",
    )
    return spark.createDataFrame(rows, PIXELS).repartition(5), scenes, image, sizes


def filled(bands):
    return np.array([[np.nan if v is None else v for v in b] for b in bands])


@pytest.mark.parametrize(("window", "stride"), [(8, 4), (5, 5), (6, 1), (4, 7)])
@pytest.mark.parametrize("block", [None, 1])
def test_training_windows(scene, window, stride, block):
    pixels, scenes, image, sizes = scene
    side = blocks.block_for(window, stride) if block is None else stride * -(-max(window, stride) // stride)
    made = blocks.training_tiles(
        blocks.blocks_of(pixels, scenes, side, ["b1", "b2"]), scenes, side, window, stride
    ).collect()
    got = {(r["scene_id"], r["tile_name"]): filled(r["bands"]) for r in made}
    named = {
        (r["scene_id"], r["tile_name"]): (r["row0"], r["col0"])
        for r in grid.training_grid(
            scenes.withColumn("gt", F.struct(*[F.lit(1.0).alias(k) for k in ("x0", "pw", "rx", "y0", "ry", "ph")])),
            window,
            stride,
        ).collect()
    }
    wanted = {k: image[k[0]][:, y : y + window, x : x + window].reshape(2, -1) for k, (y, x) in named.items()}
    # A window for which no block has anything at all has no row.
    assert set(got) <= set(wanted) and all(np.isnan(v).all() for k, v in wanted.items() if k not in got)
    assert all(np.array_equal(got[k], wanted[k], equal_nan=True) for k in got)


@pytest.mark.parametrize(("size", "overlap"), [(8, 0.0), (8, 0.5), (7, 0.4)])
def test_prediction_windows_of_both_layouts(scene, size, overlap):
    pixels, scenes, image, sizes = scene
    side = blocks.block_for(size, grid.prediction_stride(size, overlap))
    from_blocks = blocks.prediction_tiles(
        blocks.blocks_of(pixels, scenes, side, ["b1", "b2"]), scenes, side, size, overlap
    ).collect()
    from_pixels = score.prediction_tiles(pixels, scenes, size, overlap, ["b1", "b2"]).collect()
    for made in (from_blocks, from_pixels):
        assert made
        for r in made:
            own = image[r["scene_id"]][:, r["row0"] : r["row0"] + size, r["col0"] : r["col0"] + size]
            wanted = np.zeros((2, size, size))
            wanted[:, : own.shape[1], : own.shape[2]] = own
            assert (r["read_h"], r["read_w"]) == own.shape[1:]
            assert np.array_equal(filled(r["bands"]), wanted.reshape(2, -1), equal_nan=True)
    places = lambda rows: {(r["scene_id"], r["row0"], r["col0"]) for r in rows}
    assert places(from_pixels) <= places(from_blocks)


def test_missing_and_repeated_pixels(spark, scene):
    scenes = spark.createDataFrame(
        [(1, "s", 4, 4, 1)], "scene_id bigint, name string, width int, height int, band_count int"
    )
    rows = [(1, y, x, float(4 * y + x), 0.0, 1) for y in range(4) for x in range(4) if (y, x) != (1, 1)]
    pixels = spark.createDataFrame(rows, PIXELS)
    wanted = [None if k == 5 else float(k) for k in range(16)]
    assert clip.tiles_of(clip.clip_pixels(pixels, scenes, 4, 4), 4, ["b1"]).collect()[0]["bands"] == [wanted]
    assert clip.tiles_of(clip.clip_pixels(pixels, scenes, 4, 4), 4, ["b1"], nodata=-1.0).collect()[0]["bands"] == [
        [-1.0 if v is None else v for v in wanted]
    ]
    assert score.prediction_tiles(pixels, scenes, 4, 0.0, ["b1"]).collect()[0]["bands"] == [wanted]
    assert blocks.blocks_of(pixels, scenes, 8, ["b1"], nodata=9.0).collect()[0]["bands"] == [
        [9.0 if v is None else v for v in wanted]
    ]
    twice = pixels.unionByName(pixels.where("y = 2 AND x = 2"))
    for made in (
        clip.tiles_of(clip.clip_pixels(twice, scenes, 4, 4), 4, ["b1"]),
        score.prediction_tiles(twice, scenes, 4, 0.0, ["b1"]),
        blocks.blocks_of(twice, scenes, 8, ["b1"]),
    ):
        with pytest.raises(Exception, match="same pixel"):
            made.collect()
    assert blocks.blocks_of(pixels.where("false"), scenes, 8, ["b1"]).count() == 0
    with pytest.raises(ValueError, match="do not suit"):
        blocks.windows_of(blocks.blocks_of(pixels, scenes, 6, ["b1"]), scenes, 6, 4, 4, True)


def test_clipping_from_written_blocks_reads_few_of_them(spark, sf_dir):
    pixels, scenes, polygons = fx.pixels(spark, sf_dir), fx.scenes(spark, sf_dir), fx.polygons(spark, sf_dir)
    wanted = {
        (r["scene_id"], r["tile_idx"]): (r["bands"], r["mask"])
        for r in jobs.clipped_tiles(pixels, scenes, polygons, 8, 4).collect()
    }
    block = 8
    path = shared_folder(spark)
    blocks.write_blocks(blocks.blocks_of(pixels, scenes, block, jobs.BANDS), path)
    got = jobs.clipped_from_blocks(spark, path, scenes, polygons, block, 8, 4)
    assert {(r["scene_id"], r["tile_idx"]): (r["bands"], r["mask"]) for r in got.collect()} == wanted
    few = spark.createDataFrame([(0, 1, 1), (0, 1, 2)], "scene_id bigint, by bigint, bx bigint")
    read = blocks.read_blocks(spark, path, few)
    assert {(r["by"], r["bx"]) for r in read.collect()} == {(1, 1), (1, 2)} & {
        (r["by"], r["bx"]) for r in blocks.read_blocks(spark, path).collect()
    }
    assert "dynamicpruning" in read._jdf.queryExecution().executedPlan().toString().lower()


def test_shuffle_of_blocks_is_near_the_pixels(spark, scene):
    """With blocks four windows wide, each pixel travels less than twice, not (window / stride)^2 times."""
    pixels, scenes, image, sizes = scene
    side = blocks.block_for(8, 4)
    made = blocks.blocks_of(pixels, scenes, side, ["b1"])
    edges = blocks._edges(made, side, 4).select(F.sum(F.size(F.col("bands")[0]))).first()[0]
    assert edges < sum(w * h for w, h in sizes.values()) / 2


def test_slices_of_a_batch_are_of_a_bounded_number_of_pixels():
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000))], ["k"])
    parts = list(blocks.parts_of(batch, 32 * 32 * 3))
    assert sum(p.num_rows for p in parts) == 3000
    assert max(p.num_rows for p in parts) * 32 * 32 * 3 <= 1 << 20
    assert [p.num_rows for p in blocks.parts_of(batch.slice(0, 2), 4 << 20)] == [1, 1]  # a row at least
