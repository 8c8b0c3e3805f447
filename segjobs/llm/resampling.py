"""Quality by importance resampling: documents are drawn as if from the target's distribution.

Two generative models over hashed word uni- and bigrams: one of the target (documents labelled good), one of all raw
text. A document's log importance weight is the sum over its n-grams of the log ratio. Adding Gumbel noise and
keeping the k largest draws k documents without replacement, in proportion to their weights.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segjobs.llm import base
from segjobs.llm.tokens import groups, segment_hashes

BUCKETS = 16_384
MAX_FIT = 20_000
SEED = 11
SCALE = 1_000_000

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def grams(texts: list[str | None], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every word and every pair of neighbouring words, A-Z lower-cased."""
    raw = b"".join(x for t in texts for x in ((t or "").encode(), b"\n"))
    data = _LOWER[np.frombuffer(raw, np.uint8)]
    end = np.cumsum([len((t or "").encode()) + 1 for t in texts])
    solid = ~_SPACE[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    begin, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    one = segment_hashes(data, begin, stop)
    text = np.searchsorted(end, begin, "right")
    two = base.run_hashes(one, 2)
    same = text[1:] == text[:-1] if len(text) > 1 else np.zeros(0, bool)
    of = np.concatenate([text, text[1:][same]])
    return of, ((np.concatenate([base.mixed(one), two[same]]) >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def log_ratio(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, max_fit: int = MAX_FIT) -> np.ndarray:
    """log target / raw for each bucket, with one added to every count.

    Raw counts are over all texts. The target's are over at most ``max_fit`` documents labelled good, chosen by a
    hash of their ids; without any, every ratio is 0. Each task sends its sums, one row a bucket at most.
    """
    good = labels.where(F.col("quality") == 1).select(F.col("doc_id").alias("good_id")).dropna().distinct().orderBy(
        F.xxhash64("good_id"), "good_id"
    ).limit(max_fit)

    def rows(batches):
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            texts, is_good = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), bool)
            for i, j in groups(texts):
                of, bucket = grams(texts[i:j], buckets)
                raw += np.bincount(bucket, minlength=buckets)
                target += np.bincount(bucket[is_good[i:j][of]], minlength=buckets)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some), pa.array(raw[some]), pa.array(target[some])], ["bucket", "raw", "target"]
        )

    marked = docs.select("doc_id", "text").join(F.broadcast(good), F.col("doc_id") == F.col("good_id"), "left").select(
        "text", F.col("good_id").isNotNull().alias("good")
    )
    sums = marked.mapInArrow(rows, "bucket bigint, raw bigint, target bigint").groupBy(  # at most ``buckets`` rows
        "bucket"
    ).agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.ones(buckets), np.ones(buckets)
    for r in sums:
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] += r["target"]
    if not any(r["target"] for r in sums):
        return np.zeros(buckets)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def weighted(docs: DataFrame, ratio: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, n_grams, log_weight and gumbel_key (weight plus noise, in millionths) of each row."""
    buckets = len(ratio)
    shared = docs.sparkSession.sparkContext.broadcast(ratio)  # one number a bucket

    def rows(batches):
        of_bucket = shared.value
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, j in groups(texts):
                of, bucket = grams(texts[i:j], buckets)
                # without n-grams: whole numbers
                weight = np.bincount(of, of_bucket[bucket], minlength=j - i).astype(np.float64)
                mixed = base.mixed(
                    base.mixed(np.array([(x or 0) & 0xFFFFFFFFFFFFFFFF for x in ids[i:j]], np.uint64)) + np.uint64(seed)
                )
                u = ((mixed >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
                key = np.floor((weight - np.log(-np.log(u))) * SCALE).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[i:j], pa.int64()),
                        pa.array(np.bincount(of, minlength=j - i)),
                        pa.array(weight),
                        pa.array(key),
                    ],
                    ["doc_id", "n_grams", "log_weight", "gumbel_key"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        rows, "doc_id bigint, n_grams bigint, log_weight double, gumbel_key bigint"
    )


def kth_largest(df: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest value of a bigint column, exactly: 16 bits of it at a time, with counts of 65,536 rows at
    most."""
    if k < 1:
        return None
    prefix = 0
    # as unsigned numbers, order kept
    rows = df.where(F.col(column).isNotNull()).select(F.col(column).bitwiseXOR(F.lit(-(2**63))).alias("v"))
    for shift in (48, 32, 16, 0):
        digits = rows if shift == 48 else rows.where(F.shiftrightunsigned("v", shift + 16) == F.lit(prefix))
        counts = digits.groupBy(
            F.shiftrightunsigned("v", shift).bitwiseAND(F.lit(0xFFFF)).alias("digit")
        ).count().collect()
        for r in sorted(counts, key=lambda r: -r["digit"]):
            if k <= r["count"]:
                prefix = (prefix << 16) | r["digit"]
                break
            k -= r["count"]
        else:
            return None
        if prefix >= 2**63 and shift:
            prefix -= 2**64
    return (prefix ^ (1 << 63)) - (1 << 64) if (prefix ^ (1 << 63)) >= 2**63 else prefix ^ (1 << 63)


def resampled(docs: DataFrame, labels: DataFrame, keep: float | None = None, seed: int = SEED) -> DataFrame:
    """doc_id, n_grams, log_weight, gumbel_key and kept of each row of docs (doc_id, text).

    keep: the share of rows to draw; by default the share of good ones among the labelled. Rows equal to the k-th
    are kept with it. A null or empty text has weight 0, as it has no n-gram. Equal rows are drawn alike. An empty
    table gives no rows. Two passes over the texts, and one over the small table of weights; no text is shuffled.
    """
    if keep is None:
        keep = labels.agg(F.avg((F.col("quality") == 1).cast("int")).alias("share")).first()["share"]
        keep = 1.0 if keep is None else keep
    scored = base.stored(weighted(docs, log_ratio(docs, labels), seed))
    k = math.floor(scored.count() * keep + 0.5)
    least = kth_largest(scored, "gumbel_key", k)
    return scored.withColumn("kept", F.lit(False) if least is None else F.col("gumbel_key") >= F.lit(least))


def op3_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(base.table(spark, sf_dir, "documents"), base.table(spark, sf_dir, "labels"))


QUERIES = {"op3_quality_resampling": op3_quality_resampling}
#: No SQL: DuckDB has no such hash; tests compare with brute force and measure accuracy on labelled rows held out.
SQL: dict[str, str] = {}
