"""Totals of padded tiles where doubles leave a half open, and where pixels are missing."""

import duckdb
import pytest

import __spark_entry__
from segjobs.plans import catalogue

NAME = "n3_padded_minmax"

# Every tile has the least and the largest value, 1 and 33, so that a total is a whole number of eighths.
EIGHTHS = """SELECT event_id, 1 AS user_id, 'view' AS event_type, '{"k": 1}' AS props,
  (CASE WHEN event_id % 10000 // 100 % 8 = 0 AND event_id % 100 % 8 < 2 THEN 100 + event_id % 100 % 8 * 3200
    ELSE 100 + (event_id * event_id * 31 + event_id * 7919) % 3201 END)::BIGINT AS hundredths, hundredths / 100.0::DOUBLE AS value FROM range(0, 20000) r(event_id)"""
# Totals of EIGHTHS by whole numbers alone, halves away from zero.
EXACT = """WITH p AS (SELECT event_id // 10000 AS scene_id, event_id % 10000 // 100 AS y, event_id % 100 AS x, hundredths FROM events),
w AS (SELECT scene_id, i * 8 AS col0, j * 8 AS row0, (25 * (sum(hundredths) - 256 * min(hundredths)))::BIGINT AS n
  FROM p JOIN range(0, 13) a(i) ON x >= i * 8 AND x < i * 8 + 16 JOIN range(0, 13) b(j) ON y >= j * 8 AND y < j * 8 + 16 GROUP BY ALL)
SELECT scene_id, col0, row0, (sign(n) * ((abs(n) + 4) // 8))::BIGINT AS total, abs(n) % 8 = 4 AS half FROM w"""
# Pixels that have no row, and pixels without a value: some here and there, and a tile's worth of them.
GAPS = """SELECT * REPLACE (CASE WHEN event_id % 13 = 5 OR event_id % 100 >= 72 AND event_id % 100 < 88 THEN NULL ELSE value END AS value)
FROM '/root/testdata/sf0.001/events.parquet' WHERE event_id % 11 <> 7 AND event_id < 950"""


def made(spark, connection, events, folder):
    """The connection's tables `events` and `own`, the rows of the query over them."""
    connection.execute(f"CREATE TABLE events AS {events}")
    connection.execute(f"COPY events TO '{folder}/events.parquet'")
    __spark_entry__.queries()[NAME](spark, str(folder)).write.parquet(f"{folder}/out")
    connection.execute(f"CREATE VIEW own AS SELECT scene_id, col0, row0, total FROM '{folder}/out/*.parquet'")


@pytest.fixture
def connection():
    with duckdb.connect() as connection:
        yield connection


def test_halves_are_rounded_away_from_zero(spark, connection, tmp_path):
    made(spark, connection, EIGHTHS, tmp_path)
    wanted = {r[:3]: r[3:] for r in connection.execute(EXACT).fetchall()}
    got = {r[:3]: r[3] for r in connection.execute("FROM own").fetchall()}
    assert len(wanted) == 2 * 13 * 13 and sum(half for _, half in wanted.values()) > 20
    assert got == {k: total for k, (total, _) in wanted.items()}


def test_missing_pixels_equal_sql(spark, connection, tmp_path):
    made(spark, connection, GAPS, tmp_path)
    sql = f"SELECT scene_id, col0, row0, total FROM ({catalogue.SQL[NAME]})"
    assert connection.execute("SELECT count(*), count(total) FROM own").fetchall() == [(26, 26)]
    for a, b in (("FROM own", sql), (sql, "FROM own")):
        assert connection.execute(f"SELECT count(*) FROM ({a} EXCEPT ALL {b})").fetchall() == [(0,)]
