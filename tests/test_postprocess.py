"""Clean-up of polygons that are costly to make."""

from segjobs.operators import clean, jobs
from segjobs.sources import fixtures as fx


def test_polygons_are_made_once(spark, sf_dir):
    made = spark.sparkContext.accumulator(0)

    def rows(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    polygons = fx.predicted_polygons(spark, sf_dir)
    n = polygons.count()
    found, before, after = jobs.postprocess(polygons.mapInArrow(rows, polygons.schema), clean.Steps(min_area=10.0))
    assert made.value == before == n
    assert after == found.count() < n
