"""Token-id files in Simple-8b words, and the query over them.

Format: rows of a Parquet table, ordered by (shard, row). A row holds whole documents: their doc_ids, the number
of ids of each, how many ids of its shard come before it, and all their ids as 64-bit words. A word's top 4 bits are a
selector, which says how many ids of how many bits fill the other 60; selector 15 is an escape: the id needs more than
60 bits and is the next of ``escapes``. Ids are coded in blocks of BLOCK, each of which begins with a new word
(``block_words`` has its place), so blocks are coded and decoded side by side and any block can be read alone.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segjobs.llm import base
from segjobs.llm.tokens import encoder, groups

BLOCK = 1024
#: Ids in a word and bits of each, by selector.
COUNTS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 240, 1])
BITS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 0, 64])
ESCAPE = 15

_ROW = "row int, row_start bigint, doc_ids array<bigint>, n_tokens array<bigint>, n_ids bigint, words binary, block_words binary, escapes binary"
FILE_SCHEMA = "shard int, " + _ROW


def widths(ids: np.ndarray) -> np.ndarray:
    """Bits that each id needs."""
    if int(ids.max()) < 1 << 52:  # the exponent of the number as a float
        return np.where(ids > 0, (ids.astype(np.float64).view(np.int64) >> 52) - 1022, 0).astype(np.uint8)
    out = np.zeros(len(ids), np.uint8)
    for bits in range(64):
        out += ids >= np.uint64(1 << bits)
    return out


def coded(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, place of each block's first word, escaped ids). All blocks advance together, a word at a time."""
    ids, n = np.ascontiguousarray(ids, np.uint64), len(ids)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.uint32), np.empty(0, np.uint64)
    wide = np.concatenate([widths(ids), np.full(240, 99, np.uint8)])
    most, fit = wide[:n].copy(), np.zeros(n, np.uint8)
    for k in range(8):  # how many of the next ids share a word, up to eight
        if k:
            np.maximum(most, wide[k : n + k], out=most)
        fit += most <= BITS[k]
    starts = np.arange(0, n, block)
    ends = np.minimum(starts + block, n)
    for near in range(1, 8):  # a word ends with its block
        some = ends - near
        some = some[some >= starts]
        fit[some] = np.minimum(fit[some], near)
    selector = fit - np.uint8(1)  # 255 for none
    selector[fit == 0] = ESCAPE
    eight = np.flatnonzero(fit == 8)
    for s in range(8, 15):  # more and smaller ids: seldom
        count = int(COUNTS[s])
        room = ends[eight // block] - eight >= count
        eight = eight[room]
        seen = np.lib.stride_tricks.sliding_window_view(wide, count)
        for i in range(0, len(eight), 65536):
            some = eight[i : i + 65536]
            selector[some[seen[some].max(axis=1) <= BITS[s]]] = s
    step = COUNTS[selector]
    at, end, begins = starts, ends, np.zeros(n, bool)
    while len(at):
        begins[at] = True
        at = at + step[at]
        more = at < end
        if not more.all():
            at, end = at[more], end[more]
    where = np.flatnonzero(begins)
    chosen = selector[where]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in range(14):
        rows = np.flatnonzero(chosen == s)
        if rows.size:
            begin, word = where[rows], words[rows]
            for j in range(int(COUNTS[s])):
                word |= ids[begin + j] << np.uint64(int(BITS[s]) * j)
            words[rows] = word
    return words, np.searchsorted(where, starts).astype(np.uint32), ids[where[chosen == ESCAPE]]


def decoded(words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """The ids of coded(); any run of whole blocks can be given, with its own escapes."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    count = COUNTS[selector]
    begin = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.uint64)
    for s in np.unique(selector):
        rows = np.flatnonzero(selector == s)
        if s == ESCAPE:
            out[begin[rows]] = escapes
        elif BITS[s]:
            n, bits = int(COUNTS[s]), np.uint64(BITS[s])
            out[begin[rows][:, None] + np.arange(n)] = (
                words[rows][:, None] >> (np.arange(n, dtype=np.uint64) * bits)
            ) & ((np.uint64(1) << bits) - np.uint64(1))
    return out


def write(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    end_id: int = 2,
    spaces_count: bool = True,
    partitions: int | None = None,
) -> None:
    """Write the ids of all texts of ``docs`` (doc_id, text; other columns are not read) to ``path``.

    One range shuffle by doc_id; a task sorts its range and encodes it. A null text has the end id only, as an
    empty one has; repeated rows and equal doc_ids stay as rows of their own; a null doc_id comes first.
    A very long text is one row of its own. An empty table gives an empty file table.
    """
    ranges = docs.select("doc_id", "text")
    ranges = ranges.repartitionByRange(partitions, "doc_id") if partitions else ranges.repartitionByRange("doc_id")

    def rows(batches):
        number = place = 0
        encode = encoder(tokenizer_path, spaces_count).encode
        schema = pa.schema([
            ("row", pa.int32()), ("row_start", pa.int64()), ("doc_ids", pa.list_(pa.int64())), (
                "n_tokens", pa.list_(pa.int64())
            ),
            ("n_ids", pa.int64()), ("words", pa.binary()), ("block_words", pa.binary()), ("escapes", pa.binary()),
        ])
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, j in groups(texts):
                flat, size = encode(texts[i:j])
                flat = np.insert(flat, np.cumsum(size), end_id)
                words, blocks, escapes = coded(flat)
                packed = [
                    words.astype("<u8").tobytes(), blocks.astype("<u4").tobytes(), escapes.astype("<u8").tobytes()
                ]
                values = [number, place, ids[i:j], (size + 1).tolist(), len(flat), *packed]
                yield pa.RecordBatch.from_pydict(
                    {name: [v] for name, v in zip(schema.names, values, strict=True)}, schema=schema
                )
                number, place = number + 1, place + len(flat)

    out = ranges.sortWithinPartitions("doc_id").mapInArrow(rows, _ROW)
    out.select(F.spark_partition_id().alias("shard"), "*").write.option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a file table: doc_id, start (ids before it), n_tokens, ids (little-endian 32-bit, binary).

    A shard's first place is the sum of the ids of the shards before it, from one small row per shard; those rows are
    broadcast below a checked size, so that no coded word is shuffled.
    """
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    sums = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = sums.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))
    placed = files.join(base.small(before), "shard").withColumn("start", F.col("shard_start") + F.col("row_start"))

    def rows(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids = decoded(np.frombuffer(r["words"], "<u8"), np.frombuffer(r["escapes"], "<u8")).astype("<u4")
                ends = np.cumsum(r["n_tokens"])
                begins = ends - r["n_tokens"]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": r["doc_ids"],
                        "start": r["start"] + begins,
                        "n_tokens": r["n_tokens"],
                        "ids": [ids[a:b].tobytes() for a, b in zip(begins, ends, strict=True)],
                    },
                    schema=pa.schema(
                        [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())]
                    ),
                )

    return placed.select("start", "doc_ids", "n_tokens", "words", "escapes").mapInArrow(
        rows, "doc_id bigint, start bigint, n_tokens bigint, ids binary"
    )


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = base.shared_folder(spark)
    write(base.table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op1_token_ids": op1_token_ids}
#: No SQL: DuckDB has no such tokenizer; tests compare with the library itself and by round trip.
SQL: dict[str, str] = {}
