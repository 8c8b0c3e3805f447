"""Harmonic packing of token sequences: each task fills classes of reciprocal capacity on its own.

A piece of length ``s`` belongs to class ``k = capacity // s``, and each sequence of class ``k`` holds exactly ``k``
pieces of that class. How full that is depends on ``s`` alone, and documents may be cut. So a document longer than a
sequence gives whole sequences (class 1), and the rest of it is cut, longest piece first, into lengths that leave no
more than a share ``slack`` of their class's sequences empty: 1,024 (two a sequence), 682 (three), 512, 409 and so on.
What is left of a rest shrinks about as its square does, so a few pieces do.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segjobs.llm import base
from segjobs.llm.tokens import encoder, groups

CAPACITY = 2048
SLACK = 1 / 64
#: Sequences of a task lie this far apart in number from those of the next.
_APART = 1 << 40

Piece = tuple[int | None, int, int, bytes, int]  # doc_id, start, length, ids, doc_tokens


def lengths(capacity: int, slack: float) -> list[list[int]]:
    """For each rest of 0 to ``capacity - 1`` ids the lengths of its pieces, longest first."""
    size = np.arange(1, capacity)
    fits = np.where(capacity % size <= slack * capacity, size, 0)  # capacity // s pieces of s leave capacity % s empty
    longest = np.maximum.accumulate(fits).tolist()
    out: list[list[int]] = [[]]
    for rest in range(1, capacity):
        first = longest[rest - 1]
        out.append([first, *out[rest - first]])
    return out


def laid_out(left: list[Piece], capacity: int) -> list[list[Piece]]:
    """Sequences of a task's last, incomplete classes: one after another, cut where a sequence ends; what then is left
    over fills sequences whose lengths are powers of two, so none of these needs padding."""
    total = sum(p[2] for p in left)
    rest = total % capacity
    sizes = [capacity] * (total // capacity) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    out, todo = [], left[::-1]
    for size in sizes:
        own, gap = [], size
        while gap:
            doc_id, start, length, ids, n = todo.pop()
            if length > gap:
                todo.append((doc_id, start + gap, length - gap, ids[4 * gap :], n))
                length, ids = gap, ids[: 4 * gap]
            own.append((doc_id, start, length, ids, n))
            gap -= length
        out.append(own)
    return out


_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), (
        "doc_tokens", pa.int64()
    ), ("sequence_id", pa.int64()), ("offset", pa.int64()),
])


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 1,
    capacity: int = CAPACITY,
    slack: float = SLACK,
    spaces_count: bool = False,
) -> DataFrame:
    """Pieces of all documents with their places: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    docs: doc_id, text (other columns are not read). ids are little-endian 32-bit numbers; a piece's ids begin at
    ``start`` of its document's, of which there are ``doc_tokens`` with the end id. A null text is an empty one: its end
    id alone. Rows without a doc_id and repeated rows are packed each for itself. An empty table gives no rows.

    Nothing is shuffled and tasks know nothing of each other. A task holds at most one incomplete sequence of each
    class; when its rows end, it lays these out by laid_out(). Sequences are gapless from offset 0. A task's sequences
    come together, so a task that runs again replaces all of them; write the result before it is shuffled further, if
    the order of rows in docs is not fixed.
    """
    if capacity < 2 or not 0 <= slack < 1:
        raise ValueError(f"capacity {capacity} or slack {slack} is out of range")

    def rows(batches):
        from pyspark import TaskContext

        encode, cut = encoder(tokenizer_path, spaces_count).encode, lengths(capacity, slack)
        number = TaskContext.get().partitionId() * _APART
        open_: list[list[Piece]] = [[] for _ in range(capacity + 1)]  # by class
        ready: list[list[Piece]] = []

        def made() -> pa.RecordBatch:
            nonlocal number
            count = [len(s) for s in ready]
            columns = [list(c) for c in zip(*(p for s in ready for p in s), strict=True)]
            size = np.array(columns[2], np.int64)
            first = np.cumsum(count) - count
            before = np.cumsum(size) - size
            columns += [
                np.repeat(np.arange(number, number + len(ready)), count), before - np.repeat(before[first], count)
            ]
            number += len(ready)
            ready.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA
            )

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, j in groups(texts):
                flat, size = encode(texts[i:j])
                flat = np.insert(flat, np.cumsum(size), end_id).astype("<u4").tobytes()
                begin = 0
                for doc_id, n in zip(doc_ids[i:j], (size + 1).tolist(), strict=True):
                    start = 0
                    for length in [capacity] * (n // capacity) + cut[n % capacity]:
                        at = 4 * (begin + start)
                        k = capacity // length
                        own = open_[k]
                        own.append((doc_id, start, length, flat[at : at + 4 * length], n))
                        if len(own) == k:
                            ready.append(own)
                            open_[k] = []
                        start += length
                    begin += n
                if len(ready) >= 256:
                    yield made()
        ready += laid_out([p for own in open_ for p in own], capacity)
        if ready:
            yield made()

    return docs.select("doc_id", "text").mapInArrow(
        rows,
        "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint",
    )


def op13_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = pack(base.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


QUERIES = {"op13_harmonic_packing": op13_harmonic_packing}
#: No SQL: DuckDB has no such tokenizer; tests check every id and every sequence against the library's ids.
SQL: dict[str, str] = {}
