"""Whole jobs: prepare a training set, evaluate, predict and clean up."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segjobs.functions.shared import scratch, small, stored
from segjobs.operators import augment, blocks, clip, grid, losses, metrics, polygonize, prepare, score, split, validate
from segjobs.operators.clean import Steps, cleaned, usable
from segjobs.sources import catalog, sinks

BANDS = ["b1", "b2", "b3"]


def clipped_tiles(
    pixels: DataFrame,
    scenes: DataFrame,
    polygons: DataFrame,
    window: int,
    stride: int,
    burn: int = 255,
    bands: list[str] | None = None,
) -> DataFrame:
    """scene_id, tile_idx, tile_name, size, bands, mask, gt of the windows with a covered pixel. Masks come first:
    windows without one never pull pixels."""
    validate.check_not_empty(polygons, "polygons")
    runs = stored(clip.burned_runs(polygons, scenes))
    masks = stored(clip.tile_masks(runs, scenes, window, stride, burn))
    places = grid.training_grid(scenes, window, stride).select("scene_id", "tile_idx", "col0", "row0", "gt")
    places = stored(places.join(masks.select("scene_id", "tile_idx"), ["scene_id", "tile_idx"], "left_semi"))
    block = blocks.block_for(window, stride)
    under = small(stored(blocks.blocks_under(places, block, window)))
    of = lambda c: F.floor(F.col(c) / block).cast("long")
    near = pixels.withColumns({"by": of("y"), "bx": of("x")}).join(under, ["scene_id", "by", "bx"], "left_semi").drop(
        "by", "bx"
    )
    made = blocks.blocks_of(near, scenes, block, bands or BANDS)
    tiles = blocks.training_tiles(made, scenes, block, window, stride, places)
    return tiles.join(masks.drop("tile_name"), ["scene_id", "tile_idx"]).join(
        places.drop("col0", "row0"), ["scene_id", "tile_idx"]
    )


def clipped_from_blocks(
    spark: SparkSession,
    path: str,
    scenes: DataFrame,
    polygons: DataFrame,
    block: int,
    window: int,
    stride: int,
    burn: int = 255,
) -> DataFrame:
    """clipped_tiles() of scenes in blocks (blocks.write_blocks()): only files of rows of blocks under kept windows are
    read."""
    runs = stored(clip.burned_runs(polygons, scenes))
    masks = stored(clip.tile_masks(runs, scenes, window, stride, burn))
    places = grid.training_grid(scenes, window, stride).select("scene_id", "tile_idx", "col0", "row0", "gt")
    places = stored(places.join(masks.select("scene_id", "tile_idx"), ["scene_id", "tile_idx"], "left_semi"))
    found = blocks.read_blocks(spark, path, stored(blocks.blocks_under(places, block, window)))
    tiles = blocks.training_tiles(found, scenes, block, window, stride, places)
    return tiles.join(masks.drop("tile_name"), ["scene_id", "tile_idx"]).join(
        places.drop("col0", "row0"), ["scene_id", "tile_idx"]
    )


def check_clipping(scenes: DataFrame, polygons: DataFrame, window: int, stride: int, budget: int | None = None) -> dict[
    str, int
]:
    """Errors for what cannot be clipped; else counts to warn of. ``budget``: bytes that the tiles may need.

    Square pixels are needed, since windows have as many rows as columns of the same size.
    """
    checks = {
        "polygons of a wrong type": validate.wrong_types(polygons),
        "polygons in another reference system than their scene": validate.crs_mismatches(scenes, polygons),
        "scenes without polygons in their extent": validate.without_overlap(
            scenes, polygons.where("parts IS NOT NULL")
        ),
        "scenes whose pixels are not square": validate.uneven_pixels(scenes),
    }
    for what, rows in checks.items():
        if not rows.isEmpty():
            raise ValueError(f"there are {what}")
    need = grid.storage_estimate(scenes, window, stride).agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    if budget is not None and need > budget:
        raise ValueError(f"the tiles may need {need} bytes, more than {budget}")
    empty = validate.scenes_without_polygons(scenes, polygons).count()
    return {
        "estimated_bytes": need,
        "invalid_polygons": validate.invalid(polygons).count(),
        "scenes_without_polygons": empty,
    }


@scratch()
def run_clipping(
    spark: SparkSession, root: str, prefix: str, pixels: DataFrame, scenes: DataFrame, polygons: DataFrame, window: int, stride: int,
    burn: int = 255, bands: list[str] | None = None, budget: int | None = None,
) -> int:
    """A new clipping version, of all given bands; its number."""
    bands = bands or BANDS
    warnings = check_clipping(scenes, polygons, window, stride, budget)
    made = stored(clipped_tiles(pixels, scenes, polygons, window, stride, burn, bands))
    counts = clip.clip_counts(scenes, made, window, stride).agg(F.sum("tile_count"), F.sum("skipped_count")).first()
    info = {"window_size": window, "stride": stride, "burn_value": burn, "band_count": len(bands)}
    info |= {"total_tiles": counts[0] or 0, "skipped_tiles": counts[1] or 0, **warnings}
    return catalog.write_version(made, root, prefix, "clipping", info)


@scratch()
def run_splitting(
    spark: SparkSession, root: str, prefix: str, clipping: int, train: int = 80, valid: int = 10, test: int = 10
) -> int:
    """A new splitting version of a clipping version. Only names are shuffled by rank, each once; the tiles join their
    subsets, so that rows of one name stay together."""
    tiles = catalog.read_version(spark, root, prefix, "clipping", clipping)
    names = stored(split.split(tiles.select("tile_name").distinct(), train, valid, test).select("tile_name", "subset"))
    counts = {f"n_{r['subset']}": r["n"] for r in split.subset_counts(names).collect()}
    return catalog.write_version(
        tiles.join(names, "tile_name"),
        root,
        prefix,
        "splitting",
        {
            "based_on_clipping_version": clipping,
            "train_percent": train,
            "valid_percent": valid,
            "test_percent": test,
            **counts,
        },
        "subset",
    )


@scratch()
def run_augmentation(
    spark: SparkSession, root: str, prefix: str, splitting: int, methods: Iterable[str], clipping: int
) -> int:
    """A new augmented version of a splitting version; all subsets are augmented."""
    methods = [m for m in methods if m in augment.METHODS]
    if not methods:
        raise ValueError("no known augmentation is selected")
    tiles = catalog.read_version(spark, root, prefix, "splitting", splitting)
    validate.check_not_empty(tiles, "split tiles")
    made = stored(augment.augmented(tiles, methods))
    counts = {f"n_{r['subset']}": r["n"] for r in split.subset_counts(made).collect()}
    return catalog.write_version(
        made,
        root,
        prefix,
        "augmented",
        {
            "based_on_splitting_version": splitting,
            "based_on_clipping_version": clipping,
            "methods": ",".join(methods),
            **counts,
        },
        "subset",
    )


def run_all(
    spark: SparkSession,
    root: str,
    prefix: str,
    pixels: DataFrame,
    scenes: DataFrame,
    polygons: DataFrame,
    window: int,
    stride: int,
    methods: Iterable[str],
    bands: list[str] | None = None,
) -> tuple[int, int, int]:
    """All three stages, each from the version just written."""
    clipping = run_clipping(spark, root, prefix, pixels, scenes, polygons, window, stride, bands=bands)
    splitting = run_splitting(spark, root, prefix, clipping)
    return clipping, splitting, run_augmentation(spark, root, prefix, splitting, methods, clipping)


def evaluate(
    images: DataFrame, masks: DataFrame, logits: DataFrame, key: Sequence[str] = ("tile_name",)
) -> DataFrame:
    """tp, fp, tn, fn, n_tiles and rates by tile and, with a null tile, overall. key: the columns that tell rows apart;
    rows of one name are one tile."""
    tiles = prepare.paired(images, masks, key).join(logits.select(*key, "z"), list(key))
    return metrics.tile_and_overall(_test_counts(tiles))


def _test_counts(tiles: DataFrame) -> DataFrame:
    counts = metrics.tile_confusion(tiles).withColumn("split", F.lit("test"))
    return metrics.summed(counts, "split", "tile_name")


def run_evaluation(
    images: DataFrame,
    masks: DataFrame,
    make_scorer: Callable[[], score.Scorer],
    path: str,
    n_samples: int = 8,
    key: Sequence[str] = ("tile_name",),
) -> DataFrame:
    """evaluate() with logits from a model, on bands scaled by tile, written below path: metrics by tile as CSV
    (metrics), predicted masks (masks), and evenly spaced tiles with image, truth, prediction and IoU (samples).

    images: tile_name, size, bands, gt, crs; masks: tile_name, mask; both with the columns of key, which tell rows
    apart. Rows of one name are one tile: they are scaled and counted together. Tiles are scored once, beside their
    mask and own bands, and written before use.
    """
    with scratch() as keep:
        tiles = prepare.paired(images, masks, key).select(*key, "size", "bands", "mask")
        whole = tiles.withColumn("own", F.col("bands"))
        chances = score.scored(prepare.normalized(whole, "tile_name"), make_scorer)
        logit = F.transform("prob", lambda p: F.log(p / (1 - p)))
        scored = stored(chances.select(*key, F.col("own").alias("bands"), "mask", logit.alias("z")))
        out = stored(metrics.tile_and_overall(_test_counts(scored)))
        sinks.write_metrics(out.where("tile_name IS NOT NULL"), f"{path}/metrics")
        predicted = F.transform("z", metrics.predicted).alias("predicted")
        sinks.tile_masks(scored.select(*key, predicted), images, key).write.parquet(f"{path}/masks")
        names = out.where("tile_name IS NOT NULL").select("tile_name")
        chosen = metrics.evenly_spaced(names, n_samples).select("tile_name")
        samples = scored.select("tile_name", "bands", "mask", predicted).join(
            out.select("tile_name", "iou"), "tile_name"
        )
        samples.join(chosen, "tile_name", "left_semi").write.parquet(f"{path}/samples")
        return keep(out)


def predict(
    pixels: DataFrame,
    scenes: DataFrame,
    size: int,
    overlap: float,
    weights: list[float],
    bias: float,
    threshold: float = 0.5,
    bands: list[str] | None = None,
    sizes: tuple[int, ...] = validate.TILE_SIZES,
) -> DataFrame:
    """scene_id, y, x, mean, mask of every pixel, from a linear scorer on bands scaled by tile, blended where tiles
    overlap."""
    bands = bands or BANDS
    if not validate.unfit_scenes(scenes, len(bands), size, sizes).isEmpty():
        raise ValueError("the tile size is not supported, or a scene has another number of bands than the scorer")
    side = blocks.block_for(size, grid.prediction_stride(size, overlap))
    cut = blocks.prediction_tiles(blocks.blocks_of(pixels, scenes, side, bands), scenes, side, size, overlap)
    tiles = prepare.normalized_padded(cut)
    block = size if overlap == 0 else max(size // 2, grid.prediction_stride(size, overlap) // 2, 1)
    return score.positive(
        score.blended_pixels(score.blended(score.linear_scores(tiles, weights, bias), block), block), threshold
    )


def predict_polygons(mask: DataFrame, scenes: DataFrame) -> DataFrame:
    """The regions of a predicted mask as polygons."""
    return polygonize.polygons_of(stored(polygonize.regions(mask.where("mask = 1"))), scenes)


@scratch()
def run_prediction(
    pixels: DataFrame,
    scenes: DataFrame,
    path: str,
    size: int,
    overlap: float,
    weights: list[float],
    bias: float,
    outputs: str = "both",
    **options,
) -> DataFrame:
    """predict() written below path as raster, vector or both; a summary by scene. options: as for predict()."""
    mask = stored(predict(pixels, scenes, size, overlap, weights, bias, **options))
    polygons = predict_polygons(mask, scenes) if outputs != "raster" else None
    sinks.write_prediction(mask, polygons, path, outputs)
    return score.prediction_summary(scenes, grid.prediction_grid(scenes, size, overlap), outputs)


def postprocess(polygons: DataFrame, steps: Steps, path: str | None = None) -> tuple[DataFrame, int, int]:
    """The cleaned polygons, written as multipolygons if there is a path, and the counts of usable ones before and
    after. The polygons given are made once, whatever it takes to make them."""
    with scratch() as keep:
        given = stored(usable(polygons))
        made = keep(stored(cleaned(given, steps)))
        before = given.count()
    if path is not None:
        sinks.multipolygons(made.select("scene_id", "parts")).write.parquet(path)
    return made, before, made.count()


def validation_epoch(
    images: DataFrame,
    masks: DataFrame,
    logits: DataFrame,
    batch_size: int,
    log_path: str | None = None,
    run_id: int = 0,
    epoch: int = 0,
    train_loss: float | None = None,
    key: Sequence[str] = ("tile_name",),
) -> DataFrame:
    """val_loss, val_iou, val_f1 and n_batches: plain means over batches of tiles by name. With a log_path they are
    appended to the epoch log there. key: the columns that tell rows apart; rows of one name are one tile."""
    tiles = prepare.paired(images, masks, key).join(logits.select(*key, "z"), list(key))
    sums = stored(split.batches(losses.name_sums(losses.tile_sums(tiles)), batch_size))  # sums, not arrays, are ranked
    loss = losses.epoch_loss(losses.summed_losses(sums, "batch")).select(F.col("loss").alias("val_loss"))
    out = loss.crossJoin(metrics.batch_means(sums))  # one row and one row
    if log_path is not None:
        out = stored(out)
        line = out.select(
            F.lit(run_id).alias("run_id"),
            F.lit(epoch).alias("epoch"),
            F.lit(train_loss).cast("double").alias("train_loss"),
            "val_loss",
            "val_iou",
            "val_f1",
        )
        sinks.append_epochs(line, log_path)
    return out
