from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from segjobs.functions.graph import components
from segjobs.functions.ranking import ranked
from segjobs.functions.shared import scratch, stored
from segjobs.operators import augment, clean, clip, grid, jobs, losses, metrics, polygonize, score, split, validate
from segjobs.sources import catalog, sinks
from segjobs.sources import fixtures as fx


@pytest.mark.parametrize(
    ("n", "shares", "wanted"),
    [
        (1, (50, 50, 0), (0, 0, 1)),
        (2, (80, 10, 10), (2, 0, 0)),
        (3, (50, 50, 0), (2, 2, 0)),
        (5, (50, 50, 0), (2, 2, 1)),
        (15, (80, 10, 10), (12, 2, 1)),
    ],
)
def test_exact_split(spark, n, shares, wanted):
    tiles = spark.range(n).select(F.format_string("t%03d", "id").alias("tile_name"))
    got = {r["subset"]: r["n"] for r in split.subset_counts(split.split(tiles, *shares)).collect()}
    left = n
    expected = {}
    for subset, k in zip(split.SUBSETS, wanted, strict=True):
        expected[subset] = min(k, left) if subset != "test" else left
        left -= expected[subset]
    assert got == expected


def test_split_is_the_same_for_any_partitions(spark):
    tiles = spark.range(200).select(F.format_string("t%03d", "id").alias("tile_name"))
    one = split.split(tiles.coalesce(1)).select("tile_name", "subset").collect()
    eight = split.split(tiles.repartition(8)).select("tile_name", "subset").collect()
    assert sorted(one) == sorted(eight)
    compat = split.shuffled_as_list(spark, tiles).collect()
    assert sorted(r["rank"] for r in compat) == list(range(1, 201))


def test_split_arguments(spark):
    with pytest.raises(ValueError, match="add up"):
        validate.check_percentages(80, 10, 20)
    with pytest.raises(ValueError, match="no tiles"):
        split.split(spark.createDataFrame([], "tile_name string"))


def test_ranks_are_exact(spark):
    rows = spark.range(1000).select(((F.col("id") * 7919) % 1009).alias("v"))
    got = [r["v"] for r in ranked(rows, "v").orderBy("rank").collect()]
    assert got == sorted(got)


def test_scratch_deletes_its_tables_but_those_kept(spark):
    files = lambda df: [f.removeprefix("file:") for f in df.inputFiles()]
    there = lambda df: all(Path(f.removeprefix("//")).exists() for f in df)
    with scratch() as keep_outside:
        with scratch() as keep:
            gone, kept = stored(spark.range(3)), keep(stored(spark.range(4)))
            gone_files, kept_files = files(gone), files(kept)
            assert there(gone_files) and there(kept_files)
        assert not there(gone_files) and kept.count() == 4
        stays = keep_outside(stored(spark.range(5)))
    assert not there(kept_files) and stays.count() == 5
    with pytest.raises(ZeroDivisionError), scratch():
        lost = files(stored(spark.range(6)))
        raise ZeroDivisionError
    assert lost and not there(lost)
    before = stored(spark.range(7))
    with scratch():
        pass
    assert before.count() == 7


def test_planned_runs_with_nulls_ties_and_nothing(spark):
    schema = "run_id int, version int, train int, valid int, test int, tile_name string"
    rows = [(1, 1, 80, 10, 10, "x"), (1, 1, 80, 10, 10, "x"), (2, None, 80, 10, 10, "x"), (3, 1, 80, None, 20, "x"),
            (4, 1, 110, -10, 0, "x"), (5, 1, 80, 10, 9, "x"), (6, 9, 100, 0, 0, None)]
    runs = spark.createDataFrame(rows, schema)
    tiles = spark.createDataFrame([("a", 1), ("b", 1), ("c", None)], "tile_name string, version int")
    assert sorted(map(tuple, validate.unfit_runs(runs, tiles).collect())) == [
        (2, "no version"), (3, "percentages"), (4, "percentages"), (5, "percentages"), (6, "no tiles")
    ]
    assert validate.unfit_runs(runs.limit(0), tiles).isEmpty()
    assert validate.unfit_runs(runs, tiles.limit(0)).where("problem = 'no tiles'").count() == 3


def test_raster_with_missing_pixels(spark):
    rows = [(1, y, x, int((y + x) % 3 == 0)) for y in range(5) for x in range(7) if (y, x) not in ((0, 0), (1, 4))]
    mask = spark.createDataFrame(rows, "scene_id int, y int, x int, mask int")
    back = sinks.raster_pixels(sinks.raster_blocks(mask, 4), 4).collect()
    assert sorted(map(tuple, back)) == [(s, y, x, 255 * m) for s, y, x, m in rows]


def test_components_of_chains_stars_and_nothing(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, k) for k in range(101, 160)]
    got = {
        r["node"]: r["root"]
        for r in components(spark.createDataFrame(chain + star + [(5, 5), (3, 4)], "a bigint, b bigint")).collect()
    }
    assert all(got[k] == 0 for k in range(41)) and all(got[k] == 100 for k in range(100, 160))
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_prediction_grid_covers_every_pixel(spark, sf_dir):
    scenes = fx.scenes(spark, sf_dir)
    for overlap in (0.0, 0.25, 0.5):
        tiles = grid.prediction_grid(scenes, 16, overlap).collect()
        covered = {
            (r["scene_id"], y, x)
            for r in tiles
            for y in range(r["row0"], r["row0"] + r["read_h"])
            for x in range(r["col0"], r["col0"] + r["read_w"])
        }
        assert len(covered) == scenes.agg(F.sum(F.col("width") * F.col("height"))).first()[0]


def test_small_scene_has_no_training_window(spark, sf_dir):
    assert grid.training_grid(fx.scenes(spark, sf_dir), 512, 256).count() == 0


def test_confusion_adds_up(spark, sf_dir):
    rows = metrics.tile_confusion(
        fx.masks(spark, sf_dir).join(fx.logits(spark, sf_dir).select("tile_name", "z"), "tile_name")
    )
    assert rows.where("tp + fp + tn + fn <> 64").isEmpty()


def test_arguments_of_checkpoints_and_threshold(spark, sf_dir):
    with pytest.raises(ValueError, match="strategy"):
        metrics.checkpoints(fx.epoch_log(spark, sf_dir), "never")
    with pytest.raises(ValueError, match="threshold"):
        score.positive(spark.createDataFrame([], "mean double"), 1.0)
    with pytest.raises(ValueError, match="no step"):
        clean.cleaned(fx.predicted_polygons(spark, sf_dir), clean.Steps())


def test_own_augmentation(spark, sf_dir):
    tiles = fx.images(spark, sf_dir).limit(3)
    made = augment.augmented(tiles, ["Negative"], augment.METHODS | {"Negative": ("neg", lambda m: -m)})
    before = {r["tile_name"]: r["bands"] for r in tiles.collect()}
    for r in made.collect():
        assert r["tile_name"].endswith("_neg")
        assert r["bands"][0][5] == -before[r["tile_name"].removesuffix("_neg") + ".tif"][0][5]


def test_augmentation_of_mixed_sizes_and_missing_masks(spark):
    """Tiles of several sizes and bands, masks that are null or hold a null: each turned as numpy does one by one."""
    rows = []
    for k in range(60):
        size = 2 + k // 7 % 3
        bands = [[float(100 * b + p + k) for p in range(size * size)] for b in range(1 + k % 2)]
        mask = None if k % 5 == 0 else [
            None if k % 4 == 0 and p == 1 else (p + k) % 2 * 255 for p in range(size * size)
        ]
        rows.append((f"t{k}.tif", size, bands, mask, k))
    tiles = spark.createDataFrame(
        rows, "tile_name string, size int, bands array<array<double>>, mask array<smallint>, own int"
    ).coalesce(1)
    made = {(r["tile_name"], r["method"]): r for r in augment.augmented(tiles, augment.METHODS).collect()}
    assert len(made) == 7 * len(rows)
    for name, size, bands, mask, own in rows:
        for method, (suffix, turn) in augment.METHODS.items():
            got = made[f"{name.removesuffix('.tif')}_{suffix}", method]
            one = lambda v: turn(np.array(v, object).reshape(size, size)).ravel().tolist()  # noqa: B023, E731
            assert got["bands"] == [one(b) for b in bands] and got["own"] == own
            assert got["mask"] == (None if mask is None else one(mask))
    with pytest.raises(Exception, match="another length"):
        augment.augmented(tiles.withColumn("size", F.lit(3)), ["Flip H"]).collect()


def test_versions(spark, tmp_path):
    root = f"file://{tmp_path}"
    rows = spark.range(3)
    assert catalog.next_version(spark, root, "p", "clipping") == 1
    assert [catalog.write_version(rows, root, "p", "clipping", {"window_size": 8}) for _ in range(2)] == [1, 2]
    for name in ("v4", "vx"):
        (tmp_path / "p_dataset" / "clipping" / name).mkdir()
    assert catalog.versions(spark, root, "p", "clipping") == [1, 2, 4]
    assert catalog.next_version(spark, root, "p", "clipping") == 5
    found = catalog.scan_versions(spark, root, "p", "clipping").collect()
    assert [r["version"] for r in found] == [1, 2, 4] and found[2]["info"] is None and '"window_size":8' in found[0][
        "info"
    ]


def test_writers_at_once_get_different_versions(spark, tmp_path):
    root = f"file://{tmp_path}"
    with ThreadPoolExecutor(6) as pool:
        made = list(
            pool.map(
                lambda k: (catalog.write_version(spark.range(k), root, "p", "splitting", {"n": k}), k), range(1, 7)
            )
        )
    assert sorted(n for n, _ in made) == [1, 2, 3, 4, 5, 6]
    for number, k in made:
        assert catalog.read_version(spark, root, "p", "splitting", number).count() == k
    infos = {r["version"]: r["info"] for r in catalog.scan_versions(spark, root, "p", "splitting").collect()}
    assert all(f'"n":{k}' in infos[number] for number, k in made)


def test_a_writer_that_fails_leaves_no_version(spark, tmp_path):
    root = f"file://{tmp_path}"
    with pytest.raises(Exception, match="no such"):
        catalog.write_version(
            spark.range(3).select(F.raise_error(F.lit("no such row")).alias("x")), root, "p", "clipping", {}
        )
    assert catalog.versions(spark, root, "p", "clipping") == []
    assert catalog.write_version(spark.range(3), root, "p", "clipping", {}) == 1


def test_a_folder_that_is_there_is_not_written_into(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "_m").touch()
    (tmp_path / "v1").mkdir()
    (tmp_path / "v1" / "x").touch()
    assert not catalog._moved(spark, f"file://{tmp_path}/a", f"file://{tmp_path}/v1", "_m")
    assert (tmp_path / "a" / "_m").exists() and {p.name for p in (tmp_path / "v1").iterdir()} == {"x"}


def test_tile_sums(spark):
    rows = [("a", [0.0, 2.0, -1.5], [0, 255, 1], 1), ("b", [], [], 1), ("c", None, None, 1)]
    made = {
        r["tile_name"]: r.asDict()
        for r in losses.tile_sums(
            spark.createDataFrame(rows, "tile_name string, z array<double>, mask array<int>, p int")
        ).collect()
    }
    assert (made["a"]["n"], made["a"]["tp"], made["a"]["fp"], made["a"]["tn"], made["a"]["fn"]) == (3, 1, 0, 1, 1)
    z, t = np.array([0.0, 2.0, -1.5]), np.array([0, 1, 1])
    p = 1 / (1 + np.exp(-z))
    assert made["a"]["ce"] == pytest.approx(-(t * np.log(p) + (1 - t) * np.log(1 - p)).sum())
    assert made["b"]["n"] == made["c"]["n"] == 0
    with pytest.raises(Exception, match="length"):
        losses.tile_sums(
            spark.createDataFrame([("a", [0.0], [0, 1])], "tile_name string, z array<double>, mask array<int>")
        ).collect()


def test_prepare_all_stages(spark, sf_dir, tmp_path):
    root = f"file://{tmp_path}"
    numbers = jobs.run_all(
        spark,
        root,
        "fields",
        fx.pixels(spark, sf_dir),
        fx.scenes(spark, sf_dir),
        fx.polygons(spark, sf_dir),
        8,
        4,
        ["Flip H", "Mirror"],
    )
    assert numbers == (1, 1, 1)
    tiles = catalog.read_version(spark, root, "fields", "clipping", 1).count()
    made = catalog.read_version(spark, root, "fields", "augmented", 1)
    assert tiles > 0 and made.count() == 2 * tiles


def test_merge_keeps_area_and_is_idempotent(spark):
    ring = lambda x, y, w, h: [
        {"x": x, "y": y}, {"x": x + w, "y": y}, {"x": x + w, "y": y + h}, {"x": x, "y": y + h}, {"x": x, "y": y}
    ]
    rows = [
        (1, 0, [[ring(0.0, 0.0, 4.0, 4.0)]]),
        (2, 0, [[ring(3.0, 3.0, 4.0, 4.0)]]),
        (3, 0, [[ring(40.0, 0.0, 2.0, 2.0)]]),
        (4, 0, [[ring(42.0, 2.0, 2.0, 2.0)]]),
        (5, 0, None),
    ]
    polygons = spark.createDataFrame(rows, f"poly_id bigint, scene_id bigint, parts {clean.PARTS}")
    once = clean.merged(polygons).withColumn("poly_id", F.monotonically_increasing_id())
    areas = sorted(r[0] for r in once.select(clean.area(F.col("parts"))).collect())
    assert areas == pytest.approx([4, 4, 31])
    assert sorted(r[0] for r in clean.merged(once).select(clean.area(F.col("parts"))).collect()) == pytest.approx(areas)


def ring(x, y, w, h):
    return [{"x": float(a), "y": float(b)} for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y))]


def test_merge_of_a_long_chain_and_of_a_large_one_over_many_small_ones(spark):
    rows = [(k, 0, [[ring(k, 0, 1, 1 + k % 2)]]) for k in range(1500)]
    rows += [(5000 + k, 1, [[ring(7 * k, 7 * k, 1, 1)]]) for k in range(60)] + [
        (6000, 1, [[ring(-0.5, -0.5, 430, 430), ring(100.25, 20.25, 3, 3)]])
    ]
    polygons = spark.createDataFrame(rows, f"poly_id bigint, scene_id bigint, parts {clean.PARTS}")
    made = {
        r["scene_id"]: r
        for r in clean.merged(polygons).select(
            "scene_id", clean.area(F.col("parts")).alias("area"), F.size(F.col("parts")[0]).alias("rings")
        ).collect()
    }
    assert made[0]["area"] == pytest.approx(1500 * 1.5) and made[1]["area"] == pytest.approx(430 * 430 - 9) and made[1][
        "rings"
    ] == 2


def test_regions_of_scenes_of_any_number(spark):
    far = 1 << 40
    rows = [(s, y, x) for s in (1, 65537, far) for y, x in ((0, 0), (0, 1), (9, 9))]
    found = polygonize.regions(spark.createDataFrame(rows, "scene_id bigint, y bigint, x bigint"), 4).collect()
    assert len(found) == len(rows) and len({r["region"] for r in found}) == 6
    assert {(r["first_y"], r["first_x"]) for r in found} == {(0, 0), (9, 9)}


@pytest.mark.parametrize("overlap", [0.0, 0.25, 0.4, 0.5, 0.9])
def test_prediction_returns_every_pixel(spark, sf_dir, overlap):
    pixels, scenes = fx.pixels(spark, sf_dir), fx.scenes(spark, sf_dir)
    made = jobs.predict(pixels, scenes, 16, overlap, [2.0, -1.0, 0.5], -0.25, sizes=(16,))
    assert made.select("scene_id", "y", "x").distinct().count() == made.count() == pixels.count()


def test_burning_of_parts_that_overlap():
    parts = [[ring(0, -4, 4, 4)], [ring(2, -6, 4, 4)]]
    runs = clip.burn_rows(parts, 0, 0, 1, 10, 10)
    assert {(y, x) for y, a, b in runs for x in range(a, b + 1)} == {(y, x) for y in range(4) for x in range(4)} | {
        (y, x) for y in range(2, 6) for x in range(2, 6)
    }


def test_mask_of_one_large_tile(spark):
    scenes = spark.createDataFrame([(0, "s", 1024, 1024)], "scene_id bigint, name string, width int, height int")
    runs = spark.createDataFrame(
        [(0, y, 0, 1023) for y in range(1024)] + [(0, 5, 3, 9)], "scene_id bigint, y bigint, x0 bigint, x1 bigint"
    )
    got = clip.tile_masks(runs, scenes, 1024, 1024, 7).select(
        F.size("mask").alias("n"), F.expr("aggregate(mask, 0L, (a, v) -> a + v)").alias("total")
    ).collect()
    assert [(r["n"], r["total"]) for r in got] == [(1 << 20, 7 << 20)]


def test_clipping_is_checked_first(spark, sf_dir):
    scenes, polygons = fx.scenes(spark, sf_dir), fx.polygons(spark, sf_dir)
    assert jobs.check_clipping(scenes, polygons, 8, 4)["estimated_bytes"] > 0
    wide = scenes.withColumn("gt", F.col("gt").withField("ph", F.lit(-0.25)))
    away = polygons.withColumn(
        "parts",
        F.transform(
            "parts",
            lambda rings: F.transform(
                rings, lambda r: F.transform(r, lambda p: F.struct((p["x"] + 1e6).alias("x"), p["y"].alias("y")))
            ),
        ),
    )
    for what, args in (
        ("square", (wide, polygons, 8, 4)),
        ("extent", (scenes, away, 8, 4)),
        ("bytes", (scenes, polygons, 8, 4, 10)),
        ("type", (scenes, polygons.withColumn("geom_type", F.lit("Point")), 8, 4)),
    ):
        with pytest.raises(ValueError, match=what):
            jobs.check_clipping(*args)


def test_values_of_job_outputs(spark, sf_dir, tmp_path):
    """What evaluation and prediction write, against numpy: metric lines, masks and samples; raster blocks and
    polygons."""
    root = f"file://{tmp_path}"
    gt = F.struct(F.col("vec_id").cast("double").alias("x0"))
    images = fx.images(spark, sf_dir).withColumns({"gt": gt, "crs": F.lit("c")})
    jobs.run_evaluation(images, fx.masks(spark, sf_dir), lambda: lambda x: x[:, 0] * 4 - 2, f"{root}/e", 4)
    truth = {r["tile_name"]: np.array(r["mask"]) > 0 for r in fx.masks(spark, sf_dir).collect()}
    wanted = {}
    for r in images.collect():
        if r["tile_name"] in truth:
            v = np.array(r["bands"][0])
            v = np.zeros(64) if np.isnan(v).any() or v.max() <= v.min() else (v - v.min()) / (v.max() - v.min())
            on, t = v * 4 - 2 > 0, truth[r["tile_name"]]
            tp, fp, fn, tn = (on & t).sum(), (on & ~t).sum(), (~on & t).sum(), (~on & ~t).sum()
            rates = tp / (tp + fp + fn + 1e-7), 2 * tp / (2 * tp + fp + fn + 1e-7), tp / (tp + fp + 1e-7), tp / (
                tp + fn + 1e-7
            ), (tp + tn) / (64 + 1e-7)
            wanted[r["tile_name"]] = (on, rates, r["vec_id"])
    lines = spark.read.option("header", True).csv(f"{root}/e/metrics").collect()
    assert {x["filename"] for x in lines} == set(wanted)
    for x in lines:
        assert [x[c] for c in ("iou", "f1", "precision", "recall", "pixel_accuracy")] == [
            f"{v:.6f}" for v in wanted[x["filename"]][1]
        ]
    for x in spark.read.parquet(f"{root}/e/masks").collect():
        assert (np.array(x["mask"]) == 255 * wanted[x["tile_name"]][0]).all() and x["gt"]["x0"] == wanted[
            x["tile_name"]
        ][2] and x["crs"] == "c"
    samples = spark.read.parquet(f"{root}/e/samples").collect()
    names = sorted(wanted)
    assert {x["tile_name"] for x in samples} == set(names[:: max(1, len(names) // 4)])
    assert all(
        (np.array(x["predicted"]) == wanted[x["tile_name"]][0]).all() and x["iou"] == pytest.approx(
            wanted[x["tile_name"]][1][0]
        )
        for x in samples
    )

    pixels, scenes = fx.pixels(spark, sf_dir), fx.scenes(spark, sf_dir)
    jobs.run_prediction(pixels, scenes, f"{root}/p", 16, 0.25, [2.0, -1.0, 0.5], -0.25, "both", sizes=(16,))
    mask = {
        (r["scene_id"], r["y"], r["x"]): r["mask"]
        for r in jobs.predict(pixels, scenes, 16, 0.25, [2.0, -1.0, 0.5], -0.25, sizes=(16,)).collect()
    }
    width = {r["scene_id"]: r["width"] for r in scenes.collect()}
    seen = 0
    for b in spark.read.parquet(f"{root}/p/raster").collect():
        w = min(256, width[b["scene_id"]] - 256 * b["block_x"])
        for k, v in enumerate(b["values"]):
            assert v == 255 * mask[b["scene_id"], 256 * b["block_y"] + k // w, 256 * b["block_x"] + k % w]
            seen += 1
    assert seen == len(mask)
    burnt = clip.burned_pixels(clip.burned_runs(spark.read.parquet(f"{root}/p/vector"), scenes)).collect()
    assert {tuple(r) for r in burnt} == {k for k, v in mask.items() if v == 1}


def test_outputs_of_jobs(spark, sf_dir, tmp_path):
    root = f"file://{tmp_path}"
    images = fx.images(spark, sf_dir).withColumns({"gt": F.lit(1), "crs": F.lit("c")})
    out = jobs.run_evaluation(images, fx.masks(spark, sf_dir), lambda: lambda x: x[:, 0] * 4 - 2, f"{root}/e", 4)
    n = out.where("tile_name IS NOT NULL").count()
    assert spark.read.option("header", True).csv(f"{root}/e/metrics").count() == n == spark.read.parquet(
        f"{root}/e/masks"
    ).count()
    assert 4 <= spark.read.parquet(f"{root}/e/samples").where("iou IS NOT NULL").count() < n
    pixels, scenes = fx.pixels(spark, sf_dir), fx.scenes(spark, sf_dir)
    for outputs in ("raster", "vector", "both"):
        made = jobs.run_prediction(
            pixels, scenes, f"{root}/{outputs}", 16, 0.25, [2.0, -1.0, 0.5], -0.25, outputs, sizes=(16,)
        ).collect()
        assert {r["outputs"] for r in made} == {outputs}
        assert {x.name for x in (tmp_path / outputs).iterdir()} == (
            {"raster", "vector"} if outputs == "both" else {outputs}
        )
    with pytest.raises(ValueError, match="output"):
        sinks.write_prediction(pixels, None, f"{root}/none", "neither")
    cleaned, before, after = jobs.postprocess(
        fx.predicted_polygons(spark, sf_dir), clean.Steps(min_hole_area=0, min_area=10), f"{root}/clean"
    )
    assert before > after == cleaned.count() == spark.read.parquet(f"{root}/clean").where(
        "geom_type = 'MultiPolygon'"
    ).count()
    for epoch in (1, 2):
        jobs.validation_epoch(
            fx.images(spark, sf_dir), fx.masks(spark, sf_dir), fx.logits(spark, sf_dir), 8, f"{root}/log", 3, epoch, 0.5
        )
    assert [r["Epoch"] for r in spark.read.option("header", True).csv(f"{root}/log").orderBy("Epoch").collect()] == [
        "1", "2"
    ]
