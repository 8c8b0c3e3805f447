"""Vectors that are null, empty, in part null, or so small that a chance is rounded to a half."""

import duckdb
import pytest

import __spark_entry__
from segjobs.operators import split
from segjobs.plans import catalogue

# A null pixel has no score, so j5_evaluation_outputs, which takes its logits from a model, is not compared here.
NAMES = (
    "a1_a9_augmentation",
    "a9_subset_counts",
    "io10_tile_masks",
    "io7_metric_lines",
    "j2_splitting_version",
    "j5_evaluate",
    "j8_validation_epoch",
    "l1_l3_tile_sums",
    "m1_predicted_masks",
    "m2_confusion_pixels",
    "m2_confusion_tiles",
)


@pytest.fixture(scope="module")
def odd_vectors(tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    with duckdb.connect() as connection:
        connection.execute(
            f"""COPY (SELECT vec_id, CASE vec_id WHEN 11 THEN NULL WHEN 12 THEN list_transform(embedding, lambda x, i: CASE WHEN i = 3 THEN NULL ELSE x END)
            WHEN 13 THEN [] WHEN 14 THEN list_transform(embedding, lambda x: greatest(x, 0)) WHEN 16 THEN list_transform(embedding, lambda x: (x * 1e-20)::FLOAT)
            ELSE embedding END::FLOAT[] AS embedding, label FROM '/root/testdata/sf0.001/embeddings.parquet' WHERE vec_id < 100) TO '{folder}/embeddings.parquet'"""
        )
    return str(folder)


@pytest.mark.parametrize("name", NAMES)
def test_odd_vectors_equal_sql(spark, odd_vectors, name, tmp_path):
    __spark_entry__.queries()[name](spark, odd_vectors).write.parquet(f"{tmp_path}/out")
    with duckdb.connect() as connection:
        connection.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{odd_vectors}/embeddings.parquet'")
        made = f"FROM '{tmp_path}/out/*.parquet'"
        columns = ", ".join(f'"{c[0]}"' for c in connection.execute(f"DESCRIBE SELECT * {made}").fetchall())
        own, sql = f"SELECT {columns} {made}", f"SELECT {columns} FROM ({catalogue.SQL[name]})"
        assert connection.execute(f"SELECT count(*) FROM ({own})").fetchall() != [(0,)]
        for a, b in ((own, sql), (sql, own)):
            assert connection.execute(f"SELECT count(*) FROM ({a} EXCEPT ALL {b})").fetchall() == [(0,)]


def test_rows_of_one_name_are_split_by_the_rest_of_their_key(spark):
    rows = spark.createDataFrame([(i, "tile") for i in reversed(range(40))], "vec_id bigint, tile_name string")
    made = split.split(rows.repartition(7), 50, 25, 25, key=("tile_name", "vec_id")).orderBy("vec_id").collect()
    assert [r["subset"] for r in made] == ["train"] * 20 + ["valid"] * 10 + ["test"] * 10
