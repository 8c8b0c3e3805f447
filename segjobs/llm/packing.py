"""Best-fit packing of token sequences, with large items matched first.

Where a piece can lie depends on its length alone, and there are at most ``capacity`` lengths. So one aggregate
counts the pieces of each length, a plan is made for these counts (at most ``capacity`` numbers, however large the
corpus), and each piece finds its place from the plan by its rank among the pieces of its length.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from segjobs.llm import base
from segjobs.llm.tokens import encoder, groups

CAPACITY = 4096


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Places for ``counts[length]`` pieces of each length: (length, first rank, pieces, pieces in a bin, first bin,
    offset).

    Piece ``r`` of a run lies in bin ``first bin + (r - first rank) // per``, at ``offset + length * ((r - first rank) %
    per)``. Pieces above a third of the capacity go at most two to a bin: the longest left is matched with the longest
    that fits beside it. Each shorter length, longest first, then fills the bins with the smallest sufficient gap.
    """
    left = {length: n for length, n in counts.items() if n > 0}
    ranks: dict[int, int] = defaultdict(int)
    runs: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: (first bin, bins)
    bins = 0

    def put(length: int, n: int, per: int, first: int, offset: int) -> None:
        runs.append((length, ranks[length], n, per, first, offset))
        ranks[length] += n

    large = sorted((x for x in left if 3 * x > capacity), reverse=True)
    for a in large:
        while left[a]:
            b = next((x for x in large if x <= a and x + a <= capacity and left[x] > (x == a)), None)
            n = left[a] if b is None else left[a] // 2 if b == a else min(left[a], left[b])
            put(a, n, 1, bins, 0)
            left[a] -= n
            if b is not None:
                put(b, n, 1, bins, a)
                left[b] -= n
            gaps[capacity - a - (b or 0)].append((bins, n))
            bins += n
    for s in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        n = left[s]
        used = sorted(g for g in gaps if g >= s and gaps[g])
        for gap in used:
            per = gap // s
            for first, many in gaps.pop(gap):
                if not n:
                    gaps[gap].append((first, many))
                    continue
                full = min(many, n // per)
                if full:
                    put(s, full * per, per, first, capacity - gap)
                    gaps[gap - per * s].append((first, full))
                    n -= full * per
                if full < many and n and n < per:
                    put(s, n, n, first + full, capacity - gap)
                    gaps[gap - n * s].append((first + full, 1))
                    n, full = 0, full + 1
                if full < many:
                    gaps[gap].append((first + full, many - full))
            if not n:
                break
        if n:
            per = capacity // s
            full, rest = divmod(n, per)
            if full:
                put(s, full * per, per, bins, 0)
                gaps[capacity - per * s].append((bins, full))
            if rest:
                put(s, rest, rest, bins + full, 0)
                gaps[capacity - rest * s].append((bins + full, 1))
            bins += full + bool(rest)
    return runs


PIECES = "doc_id bigint, piece int, start bigint, length int, ids binary, part int, rank_in_part bigint"


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, spaces_count: bool) -> DataFrame:
    """Token pieces of at most ``capacity`` ids: only longer documents are cut; ids as little-endian 32-bit numbers."""

    def rows(batches):
        from pyspark import TaskContext

        encode, part = encoder(tokenizer_path, spaces_count).encode, TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, j in groups(texts):
                flat, size = encode(texts[i:j])
                ends = np.cumsum(size)
                flat = np.insert(flat, ends, end_id).astype("<u4")
                out: list[tuple] = []
                begin = 0
                for doc_id, n in zip(doc_ids[i:j], (size + 1).tolist(), strict=True):
                    for k, at in enumerate(range(0, n, capacity)):
                        length = min(capacity, n - at)
                        out.append(
                            (
                                doc_id,
                                k,
                                at,
                                length,
                                flat[begin + at : begin + at + length].tobytes(),
                                part,
                                seen[length],
                            )
                        )
                        seen[length] += 1
                    begin += n
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(c, t)
                        for c, t in zip(
                            zip(*out, strict=True),
                            (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int64()),
                            strict=True,
                        )
                    ],
                    ["doc_id", "piece", "start", "length", "ids", "part", "rank_in_part"],
                )

    return docs.select("doc_id", "text").mapInArrow(rows, PIECES)


def pack(
    docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY, spaces_count: bool = False
) -> DataFrame:
    """Pieces of all documents with their places: doc_id, piece, start, length, ids, sequence_id, offset.

    docs: doc_id, text (other columns are not read). A null text is an empty one: its end id alone. Repeated rows
    are packed each for itself. An empty table gives no rows. Sequences are gapless from offset 0 and hold at most
    ``capacity`` ids. The pieces are written once to the shared folder, so ranks stay as they are if tasks rerun. The
    counts by length and task, by which pieces find their ranks, are broadcast below a checked size; beyond it pieces
    are shuffled to them.
    """
    spark = docs.sparkSession
    cut = base.stored(pieces(docs, tokenizer_path, end_id, capacity, spaces_count))
    by_part = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    # at most ``capacity`` rows
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = by_part.select(
        "length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before")
    )
    # One row a length; its runs are few, since each ends with a length or a gap used up.
    runs: dict[int, list] = defaultdict(list)
    for length, *run in plan(counts, capacity):
        runs[length].append(tuple(run))
    fields = [StructField(x, LongType()) for x in ("from_rank", "n", "per", "first_bin", "at")]
    planned = spark.createDataFrame(
        list(runs.items()),
        StructType([StructField("length", IntegerType()), StructField("runs", ArrayType(StructType(fields)))]),
    )
    rank = F.col("rank_in_part") + F.col("before")
    placed = cut.join(base.small(before), ["length", "part"]).withColumn("rank", rank).join(
        F.broadcast(planned), "length"
    )
    placed = placed.withColumn(
        "run",
        F.filter("runs", lambda r: (r["from_rank"] <= F.col("rank")) & (F.col("rank") < r["from_rank"] + r["n"]))[0],
    )
    nth = F.col("rank") - F.col("run.from_rank")
    return placed.select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids",
        (F.col("run.first_bin") + F.floor(nth / F.col("run.per"))).cast("long").alias("sequence_id"),
        (F.col("run.at") + F.col("length") * (nth % F.col("run.per"))).cast("long").alias("offset"),
    )


def op4_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = pack(base.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset"
    )


QUERIES = {"op4_bestfit_packing": op4_bestfit_packing}
#: No SQL: DuckDB has no such tokenizer; tests check every piece and every sequence against the library's ids.
SQL: dict[str, str] = {}
