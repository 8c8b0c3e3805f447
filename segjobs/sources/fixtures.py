"""Scenes, polygons, tiles and logs derived from the given tables by arithmetic on their keys (FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segjobs.functions.shared import table

CRS = "EPSG:32611"
PIXELS_A_SCENE = 10_000


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scene_id, y, x, b1, b2, b3, ref_mask."""
    at = F.col("event_id") % PIXELS_A_SCENE
    return table(spark, sf_dir, "events").select(
        F.floor(F.col("event_id") / PIXELS_A_SCENE).alias("scene_id"), F.floor(at / 100).alias("y"), (
            F.col("event_id") % 100
        ).alias("x"),
        F.col("value").cast("double").alias("b1"), F.regexp_extract("props", "([0-9]+)", 1).cast("double").alias(
            "b2"
        ), F.col("user_id").cast("double").alias("b3"),
        (F.col("event_type") == "error").cast("int").alias("ref_mask"),
    )


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scene_id, name, width, height, band_count, crs, gt."""
    size = pixels(spark, sf_dir).groupBy("scene_id").agg(
        (F.max("x") + 1).cast("int").alias("width"), (F.max("y") + 1).cast("int").alias("height")
    )
    gt = F.struct(
        (1000 + 100 * F.col("scene_id")).cast("double").alias("x0"),
        F.lit(0.5).alias("pw"),
        F.lit(0.0).alias("rx"),
        F.lit(5000.0).alias("y0"),
        F.lit(0.0).alias("ry"),
        F.lit(-0.5).alias("ph"),
    )
    return size.select(
        "scene_id",
        F.concat(F.lit("scene "), F.col("scene_id").cast("string"), F.lit("!")).alias("name"),
        "width",
        "height",
        F.lit(3).alias("band_count"),
        F.lit(CRS).alias("crs"),
        gt.alias("gt"),
    )


def n_scenes(spark: SparkSession, sf_dir: str) -> int:
    return -(-table(spark, sf_dir, "events").count() // PIXELS_A_SCENE)


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def _rectangle(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.array(_point(x, y), _point(x + w, y), _point(x + w, y + h), _point(x, y + h), _point(x, y))


def _placed(ring: Column) -> Column:
    """From pixel to map coordinates of the scene."""
    return F.transform(ring, lambda p: _point(1000 + 100 * F.col("scene_id") + 0.5 * p["x"], 5000 - 0.5 * p["y"]))


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label polygons: poly_id, scene_id, geom_type, parts, crs. Rectangles, triangles and rectangles with a hole."""
    k = F.col("s_suppkey")
    px, py = (k * k * 7 + k * 37) % 101 + 0.25, (k * k * 3 + k * 53) % 103 + 0.25
    w, h = 2 + k % 7, 2 + k % 5
    triangle = F.array(_point(px, py), _point(px + w, py), _point(px, py + h + 0.125), _point(px, py))
    rings = F.when(k % 3 == 1, F.array(triangle)).when(
        k % 3 == 2, F.array(_rectangle(px, py, w, h), _rectangle(px + 0.5, py + 0.5, w - 1, h - 1))
    ).otherwise(F.array(_rectangle(px, py, w, h)))
    own = table(spark, sf_dir, "supplier").select(
        k.alias("poly_id"), (k % n_scenes(spark, sf_dir)).alias("scene_id"), rings.alias("rings")
    )
    return own.select(
        "poly_id",
        "scene_id",
        F.lit("Polygon").alias("geom_type"),
        F.array(F.transform("rings", _placed)).alias("parts"),
        F.lit(CRS).alias("crs"),
    )


def predicted_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean-up input: grid-aligned rectangles, some with a hole of 1 x 1, some with a second part: poly_id, scene_id,
    parts."""
    k = F.col("p_partkey")
    x, y, w, h = (k * k * 7 + k * 37) % 449, (k * k * 3 + k * 53) % 443, 1 + F.col("p_size") % 9, 1 + k % 7
    whole = F.array(_rectangle(x, y, w, h))
    first = F.when(
        (k % 4 == 0) & (w >= 3) & (h >= 3),
        F.array(_rectangle(x, y, w, h), _rectangle(x + 1, y + 1, F.lit(1), F.lit(1))),
    ).otherwise(whole)
    parts = F.when(k % 8 == 0, F.array(first, F.array(_rectangle(x + 20, y, w, h)))).otherwise(F.array(first))
    return table(spark, sf_dir, "part").select(
        k.alias("poly_id"), F.floor(k / 2000).alias("scene_id"), parts.alias("parts")
    )


def slanted_polygons(
    spark: SparkSession, sf_dir: str, step: float = 1.0, east: float = 0.0, north: float = 0.0
) -> DataFrame:
    """Clean-up input with slanted edges: diamonds, some with a diamond for a hole, in units of step from (east, north):
    poly_id, scene_id, parts."""
    k = F.col("p_partkey")
    x, y, r = (k * k * 11 + k * 29) % 397, (k * k * 5 + k * 61) % 389, 2 + k % 8
    at = lambda dx, dy: _point(
        F.lit(east) + F.lit(step) * (x + dx), F.lit(north) + F.lit(step) * (y + dy)
    )
    diamond = lambda n: F.array(
        at(-n, F.lit(0)), at(F.lit(0), -n), at(n, F.lit(0)), at(F.lit(0), n), at(-n, F.lit(0))
    )
    rings = F.when((k % 3 == 0) & (r >= 4), F.array(diamond(r), diamond(r - 2))).otherwise(F.array(diamond(r)))
    return table(spark, sf_dir, "part").select(
        k.alias("poly_id"), F.floor(k / 1000).alias("scene_id"), F.array(rings).alias("parts")
    )


def holed_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares of 12 with two holes of many places: inside, sticking out, outside, overlapping or in each other; or one
    of each shape of U in the other: poly_id, scene_id, parts."""
    k = F.col("p_partkey")
    x, y, w, u, v, s = k % 13 - 1, k % 11, 1 + k % 4, (k * 7) % 12, (k * 5) % 12, 1 + k % 3
    squares = F.array(
        _rectangle(F.lit(0), F.lit(0), F.lit(12), F.lit(12)), _rectangle(x, y, w, w), _rectangle(u, v, s, s)
    )
    path = lambda *points: F.array(*[_point(F.lit(a), F.lit(b)) for a, b in points])
    outer = path((0, 0), (10, 0), (10, 10), (7, 10), (7, 3), (3, 3), (3, 10), (0, 10), (0, 0))
    inner = path((1, 1), (9, 1), (9, 9), (8, 9), (8, 2), (2, 2), (2, 9), (1, 9), (1, 1))
    rings = F.when(k % 29 == 0, F.array(outer, inner)).otherwise(squares)
    return table(spark, sf_dir, "part").select(
        k.alias("poly_id"), F.lit(0).alias("scene_id"), F.array(rings).alias("parts")
    )


#: What tells tiles apart: names have five digits of vec_id, so that from 100,000 vectors on several share one.
TILE_KEY = ("vec_id", "tile_name")


def _tile_name() -> Column:
    return F.concat(F.lit("tile_"), F.lpad(F.col("vec_id").cast("string"), 5, "0"), F.lit(".tif"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors with values; a null or empty one is no tile."""
    return table(spark, sf_dir, "embeddings").where(F.size("embedding") > 0)


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 tiles of one band: tile_name, size, bands. Some are flat, some have one NaN."""
    band = F.when(F.col("vec_id") % 41 == 0, F.array_repeat(F.lit(1.5), 64)).when(
        F.col("vec_id") % 43 == 0,
        F.concat(F.array(F.lit(float("nan"))), F.slice(F.col("embedding").cast("array<double>"), 2, 63)),
    ).otherwise(F.col("embedding").cast("array<double>"))
    return _vectors(spark, sf_dir).select(
        "vec_id", _tile_name().alias("tile_name"), F.lit(8).alias("size"), F.array(band).alias("bands")
    )


def masks(spark: SparkSession, sf_dir: str, by_name: bool = False) -> DataFrame:
    """tile_name, mask of 0 and 255; missing for one tile in ten, empty for one in seventeen. by_name: missing only
    where no row of that name has one."""
    value = F.transform(
        "embedding",
        lambda _, p: F.when(
            (F.col("vec_id") % 17 != 0) & ((p + F.col("label") + F.col("vec_id")) % 3 == 0), 255
        ).otherwise(0).cast("short"),
    )
    own = _vectors(spark, sf_dir)
    every = own.select("vec_id", _tile_name().alias("tile_name"), value.alias("mask"))
    if by_name:
        return every.join(every.where("vec_id % 10 <> 9").select("tile_name"), "tile_name", "left_semi")
    return every.where("vec_id % 10 <> 9")


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tile_name, z: four times the embedding; all -1 for one tile in 34."""
    z = F.when(F.col("vec_id") % 34 == 0, F.array_repeat(F.lit(-1.0), 64)).otherwise(
        F.transform(F.col("embedding").cast("array<double>"), lambda v: 4 * v)
    )
    return _vectors(spark, sf_dir).select("vec_id", _tile_name().alias("tile_name"), z.alias("z"))


def epoch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, epoch, train_loss, val_loss, val_iou, val_f1."""
    k = F.col("o_orderkey")
    iou = (k * 7919 % 1000) / 1000.0
    rows = table(spark, sf_dir, "orders").select(
        (k % 20).alias("run_id"), (F.floor(k / 20) + 1).alias("epoch"), iou.alias("val_iou")
    )
    return rows.select(
        "run_id",
        "epoch",
        (1 / (F.col("epoch") + 1.0)).alias("train_loss"),
        (1 - F.col("val_iou")).alias("val_loss"),
        "val_iou",
        (2 * F.col("val_iou") / (1 + F.col("val_iou"))).alias("val_f1"),
    )


#: The same tables for DuckDB, as named subqueries.
SQL = {
    "pixels": """pixels AS (SELECT event_id // 10000 AS scene_id, (event_id % 10000) // 100 AS y, event_id % 100 AS x, CAST(value AS DOUBLE) AS b1,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS b2, CAST(user_id AS DOUBLE) AS b3, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS ref_mask FROM events)""",
    "scenes": """scenes AS (SELECT event_id // 10000 AS scene_id, 'scene ' || (event_id // 10000) || '!' AS name, max(event_id % 100) + 1 AS width, max((event_id % 10000) // 100) + 1 AS height, 3 AS band_count,
  1000.0 + 100 * (event_id // 10000) AS x0, 0.5 AS pw, 5000.0 AS y0, -0.5 AS ph FROM events GROUP BY ALL)""",
    "shapes": """shapes AS (SELECT s_suppkey AS poly_id, s_suppkey % (SELECT CAST(ceil(count(*) / 10000.0) AS BIGINT) FROM events) AS scene_id, s_suppkey % 3 AS shape,
  (s_suppkey * s_suppkey * 7 + s_suppkey * 37) % 101 + 0.25::DOUBLE AS px, (s_suppkey * s_suppkey * 3 + s_suppkey * 53) % 103 + 0.25::DOUBLE AS py,
  (2 + s_suppkey % 7)::DOUBLE AS w, (2 + s_suppkey % 5)::DOUBLE AS h FROM supplier)""",
    "inside": """inside AS (SELECT DISTINCT p.scene_id, p.y, p.x, s.poly_id FROM pixels p JOIN shapes s ON p.scene_id = s.scene_id AND p.x + 0.5 > px AND p.x + 0.5 < px + w AND p.y + 0.5 > py AND p.y + 0.5 < py + h + 0.125
  WHERE CASE shape WHEN 1 THEN (p.x + 0.5 - px) / w + (p.y + 0.5 - py) / (h + 0.125) < 1
    WHEN 2 THEN p.y + 0.5 < py + h AND NOT (p.x + 0.5 > px + 0.5 AND p.x + 0.5 < px + w - 0.5 AND p.y + 0.5 > py + 0.5 AND p.y + 0.5 < py + h - 0.5)
    ELSE p.y + 0.5 < py + h END)""",
    "tilepx": """tilepx AS (SELECT vec_id, 'tile_' || lpad(CAST(vec_id AS VARCHAR), 5, '0') || '.tif' AS tile_name, label, p, p // 8 AS y, p % 8 AS x,
  CASE WHEN vec_id % 41 = 0 THEN 1.5 WHEN vec_id % 43 = 0 AND p = 0 THEN 'nan'::DOUBLE ELSE v END AS v,
  CASE WHEN vec_id % 17 <> 0 AND (p + label + vec_id) % 3 = 0 THEN 1 ELSE 0 END AS t, vec_id % 10 <> 9 AS has_mask, CASE WHEN vec_id % 34 = 0 THEN -1.0::DOUBLE ELSE 4 * v END AS z
  FROM (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings))""",
    "epoch_log": """epoch_log AS (SELECT o_orderkey % 20 AS run_id, o_orderkey // 20 + 1 AS epoch, (o_orderkey * 7919 % 1000) / 1000.0::DOUBLE AS val_iou FROM orders)""",
    "diamonds": """diamonds AS (SELECT p_partkey AS poly_id, p_partkey // 1000 AS scene_id, (p_partkey * p_partkey * 11 + p_partkey * 29) % 397 AS x, (p_partkey * p_partkey * 5 + p_partkey * 61) % 389 AS y,
  2 + p_partkey % 8 AS r, p_partkey % 3 = 0 AND 2 + p_partkey % 8 >= 4 AS hole FROM part)""",
    "holed": """holed AS (SELECT p_partkey AS poly_id, p_partkey % 13 - 1 AS x, p_partkey % 11 AS y, 1 + p_partkey % 4 AS w, (p_partkey * 7) % 12 AS u, (p_partkey * 5) % 12 AS v, 1 + p_partkey % 3 AS s FROM part WHERE p_partkey % 29 <> 0)""",
    "rects": """rects AS (SELECT p_partkey AS poly_id, p_partkey // 2000 AS scene_id, (p_partkey * p_partkey * 7 + p_partkey * 37) % 449 AS x0, (p_partkey * p_partkey * 3 + p_partkey * 53) % 443 AS y0,
  1 + p_size % 9 AS w, 1 + p_partkey % 7 AS h, p_partkey % 4 = 0 AND 1 + p_size % 9 >= 3 AND 1 + p_partkey % 7 >= 3 AS hole, p_partkey % 8 = 0 AS two FROM part)""",
}


def sql(names: str, query: str, recursive: bool = False) -> str:
    """A statement over the named subqueries (space-separated) and others that the query defines itself."""
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(SQL[n] for n in names.split()) + (
        ",\n" if not query.lstrip().startswith("SELECT") else "\n"
    ) + query
