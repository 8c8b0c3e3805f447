"""Near duplicates: MinHash signatures joined by an inverted list of their coordinates.

Documents with equal shingle sets are one node. A node is posted under each (coordinate, value) of its signature;
two nodes with the wanted similarity collide in at least ``least_matches`` of the ``COORDINATES`` but for a chance of
about 1e-8 at the threshold itself. By the pigeonhole such nodes also share one of their rarest
``COORDINATES - least_matches + 1`` values, so only those short lists are merged (the prefix); the long lists are
skipped, and a candidate's collisions in them are counted on the signatures. Pairs with enough collisions are
confirmed on their full sets.

No long list is expanded into all its pairs. First each list links its members with one leader, the member that shares
most values with others, and links give components. Pairs within a component are joined already, so only lists
with several are looked at again: those of up to ``SHORT`` members pair by pair, longer ones together as groups (lists
that overlap are one group), whose members are compared on their full sets in blocks of ``BLOCK``. Blocks
of one component, and of sizes too far apart for the similarity, are left out, and a task returns only links that join.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segjobs.functions.graph import components
from segjobs.llm import base
from segjobs.llm.tokens import groups, segment_hashes

COORDINATES = 64
SHORT = 32
BLOCK = 128
CHUNK = 256

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEPS = np.random.Generator(np.random.PCG64(9)).integers(0, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(
    2
) + np.uint64(1)


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """The distinct shingles' hashes of each text, ascending; one of the whole if it has fewer words, none without."""
    raw = b"".join(x for t in texts for x in ((t or "").encode(), b"\n"))
    data = _LOWER[np.frombuffer(raw, np.uint8)]
    end = np.cumsum([len((t or "").encode()) + 1 for t in texts])
    solid = ~_SPACE[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    begin, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = segment_hashes(data, begin, stop)
    runs = base.run_hashes(hashes, words)
    upto = np.searchsorted(begin, end)
    out = []
    for a, b in zip(np.concatenate([[0], upto[:-1]]).tolist(), upto.tolist(), strict=True):
        n = b - a
        out.append(
            np.unique(runs[a : b - words + 1]) if n >= words else base.run_hashes(hashes[a:b], n) if n else hashes[:0]
        )
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least value of each coordinate's order of all shingles, marked with the coordinate."""
    least = np.full(COORDINATES, 2**64 - 1, np.uint64)
    for i in range(0, len(shingles), 1024):
        np.minimum(least, (_STEPS[:, None] * shingles[i : i + 1024]).min(axis=1), out=least)
    return base.mixed(least ^ (np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))).view(
        np.int64
    )


def node_of(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - 2**63


def least_matches(similarity: float) -> int:
    """Six standard deviations below the expected number of equal coordinates, at least one."""
    return max(1, math.floor(COORDINATES * similarity - 6 * math.sqrt(COORDINATES * similarity * (1 - similarity))))


def signed(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, node (a hash of the whole set) and signature of each row; the last two null without words."""

    def rows(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, j in groups(texts):
                sets = shingle_sets(texts[i:j], words)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[i:j], pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()),
                        pa.array([signature(s) if len(s) else None for s in sets], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n_shingles", "node", "signature"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        rows, "doc_id bigint, n_shingles bigint, node bigint, signature array<bigint>"
    )


def enough(similarity: tuple[int, int], common: int, a: int, b: int) -> bool:
    num, den = similarity
    return den * common >= num * (a + b - common)


def shingled(texts: DataFrame, words: int) -> DataFrame:
    """node and set (its shingles' hashes, as binary) of rows (node, text) whose text has that node's set."""

    def rows(batches):
        for batch in batches:
            nodes, text = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, j in groups(text):
                sets = shingle_sets(text[i:j], words)
                # else another row's text under the same doc_id
                good = [(k, s.tobytes()) for k, s in zip(nodes[i:j], sets, strict=True) if node_of(s) == k]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g[0] for g in good], pa.int64()), pa.array([g[1] for g in good], pa.binary())],
                    ["node", "set"],
                )

    return texts.mapInArrow(rows, "node bigint, set binary").dropDuplicates(["node"])


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; sets: node, set.

    Each a's set meets those of its partners, about CHUNK of them in one group: it goes along once a group.
    """
    many = pairs.groupBy("a").agg(F.count("*").alias("n"))
    dealt = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / CHUNK)).alias("chunk"))
    head = dealt.select("a", "chunk").distinct().join(sets, F.col("a") == F.col("node")).select(
        "a", "chunk", F.lit(0).alias("role"), "node", "set"
    )
    rest = dealt.join(sets, F.col("b") == F.col("node")).select("a", "chunk", F.lit(1).alias("role"), "node", "set")

    def rows(batches):
        key, own = None, np.empty(0, np.uint64)
        for batch in batches:
            found = []
            for lead, chunk, role, node, packed in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                s = np.frombuffer(packed, np.uint64)
                if role == 0:
                    key, own = (lead, chunk), s
                elif key == (lead, chunk):
                    at = np.minimum(np.searchsorted(own, s), len(own) - 1)
                    if enough(similarity, int((own[at] == s).sum()), len(own), len(s)):
                        found.append((lead, node))
            yield _links(found)

    # Rows of a key stream through the task in order; only its first set is held.
    return head.unionByName(rest).repartition("a", "chunk").sortWithinPartitions("a", "chunk", "role").mapInArrow(
        rows, "a bigint, b bigint"
    )


def joining(members: list[tuple[int, int, int, np.ndarray]], similarity: tuple[int, int]) -> list[tuple[int, int]]:
    """Links between members (side, node, label, set) of different sides and labels that are enough to join what all
    such links join.

    If all are of one side, every two are compared. Sets are compared as rows of a matrix of their common shingles.
    """
    side = np.array([m[0] for m in members])
    size = np.array([len(m[3]) for m in members])
    _, which, times = np.unique(np.concatenate([m[3] for m in members]), return_inverse=True, return_counts=True)
    column = np.cumsum(times > 1) - 1
    row = np.repeat(np.arange(len(members)), size)
    some = times[which] > 1
    table = np.zeros((len(members), int(column[-1]) + 1), np.float32)
    table[row[some], column[which[some]]] = 1
    common = np.rint(table @ table.T).astype(np.int64)
    num, den = similarity
    close = np.triu(den * common >= num * (size[:, None] + size - common), 1)
    if (side != side[0]).any():
        close &= side[:, None] != side
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for i, j in np.argwhere(close).tolist():
        a, b = find(members[i][2]), find(members[j][2])
        if a != b:
            root[a] = b
            out.append((members[i][1], members[j][1]))
    return out


def joined_in_blocks(members: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Links (a, b) that join different labels within a group; members: grp, node, label, size.

    A block is up to about BLOCK members of one group, alike in size, and of one label if that has many members. Pairs
    of blocks are dealt to tasks, so a large group is the work of many.
    """
    num, den = similarity
    big = members.groupBy("grp", "label").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select(
        "grp", "label", F.lit(True).alias("big")
    )
    ratio = math.log(den / num)
    own = members.join(big, ["grp", "label"], "left").withColumns(
        {"of": F.when(F.col("big"), F.col("label")), "bin": F.floor(F.log("size") / ratio)}
    )
    many = own.groupBy("grp", "of", "bin").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    own = own.join(
        many.withColumnRenamed("of", "of2").withColumnRenamed("grp", "grp2").withColumnRenamed("bin", "bin2"),
        (F.col("grp") == F.col("grp2")) & F.col("of").eqNullSafe(F.col("of2")) & (F.col("bin") == F.col("bin2")),
    )
    own = own.withColumn(
        "block",
        F.xxhash64(
            "grp", F.coalesce("of", F.lit(0)), F.col("of").isNull(), "bin", F.pmod(F.xxhash64("node"), F.col("parts"))
        ),
    ).select("grp", "block", "of", "bin", "node", "label")
    own = base.stored(own)
    blocks = own.select("grp", "block", "of", "bin").distinct()
    other = blocks.select("grp", *[F.col(c).alias(f"{c}_b") for c in ("block", "of", "bin")])
    pairs = blocks.join(other, "grp").where(
        "block <= block_b AND abs(bin - bin_b) <= 1 AND NOT coalesce(of = of_b, false)"
    )
    pairs = pairs.select(
        F.xxhash64("block", "block_b").alias("pair"),
        F.explode(F.array_distinct(F.array("block", "block_b"))).alias("block"),
    )
    dealt = own.join(pairs, "block").join(sets, "node").select("pair", "block", "node", "label", "set")

    def rows(batches):
        key, held = None, []
        for batch in batches:
            found = []
            for pair, block, node, label, packed in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if pair != key:
                    if len(held) > 1:
                        found += joining(held, similarity)
                    key, held = pair, []
                held.append((block, node, label, np.frombuffer(packed, np.uint64)))
            yield _links(found)
        if len(held) > 1:
            yield _links(joining(held, similarity))

    return dealt.repartition("pair").sortWithinPartitions("pair").mapInArrow(rows, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, words: int = 5, similarity: tuple[int, int] = (80, 100)) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of docs (doc_id, text; other columns are not read).

    Rows are linked if num / den of the union of their sets of ``words``-word shingles is common to both.
    component_id is the least doc_id reachable over links; kept marks the rows that have it as their own. A null,
    empty or blank text is linked with nothing. Repeated rows have equal results. Very long texts count whole.
    """
    num, den = similarity
    least = least_matches(num / den)
    rows = base.stored(signed(docs, words))
    full = rows.where(F.col("node").isNotNull())
    nodes = base.stored(
        full.groupBy("node").agg(
            F.min("doc_id").alias("low"), F.first("n_shingles").alias("size"), F.first("signature").alias("signature")
        )
    )
    posts = nodes.select("node", F.explode("signature").alias("value"))
    shared = posts.groupBy("value").agg(F.count("*").alias("n")).where("n > 1")
    by_node = posts.join(shared, "value").groupBy("node").agg(  # COORDINATES at most
        F.sort_array(F.collect_list(F.struct("n", "value"))).alias("rare"), F.sum("n").alias("mass")
    )
    by_node = by_node.where(F.size("rare") >= least).select(
        "node",
        F.size("rare").alias("many"),
        "mass",
        F.explode(F.slice("rare", 1, F.size("rare") - F.lit(least - 1))).alias("x"),
    )
    lists = base.stored(
        by_node.select("node", F.struct("many", "mass", "node").alias("weight"), F.col("x.value").alias("value"))
    )
    signatures = base.stored(
        nodes.join(lists.select("node").distinct(), "node", "left_semi").select("node", "low", "size", "signature")
    )

    def enough_matches(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose sizes allow the similarity and that collide often enough."""
        mark = lambda x: signatures.select(
            F.col("node").alias(x), F.col("size").alias(f"size_{x}"), F.col("signature").alias(f"signature_{x}")
        )
        near = pairs.join(mark("a"), "a").join(mark("b"), "b").where(
            den * F.least("size_a", "size_b") >= num * F.greatest("size_a", "size_b")
        )
        return base.stored(
            near.where(F.size(F.array_intersect("signature_a", "signature_b")) >= least).select("a", "b")
        )

    heads = lists.groupBy("value").agg(F.max("weight").alias("lead"), F.count("*").alias("n")).where("n > 1").select(
        "value", F.col("lead.node").alias("a")
    )
    stars = enough_matches(
        lists.join(heads, "value").where("node <> a").select("a", F.col("node").alias("b")).distinct()
    )

    wanted = base.small(signatures.select("node", "low"))
    sets = base.stored(
        shingled(
            docs.select("doc_id", "text").join(wanted, F.col("doc_id") == F.col("low")).select("node", "text"), words
        )
    )
    linked = base.stored(confirmed(stars, sets, similarity))

    label = components(linked)
    labelled = lists.select("value", "node").join(label, "node", "left").select(
        "value", "node", F.coalesce("root", "node").alias("label")
    )
    mixed = labelled.groupBy("value").agg(
        F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("n")
    ).where("x < y").select("value", "n")
    left = base.stored(labelled.join(mixed, "value"))
    short = left.where(F.col("n") <= SHORT)
    pairs = short.select("value", F.col("node").alias("a"), F.col("label").alias("x")).join(
        short.select("value", F.col("node").alias("b"), F.col("label").alias("y")), "value"
    ).where("a < b AND x <> y").select("a", "b").distinct()
    links = linked.unionByName(confirmed(enough_matches(pairs), sets, similarity))
    long = left.where(F.col("n") > SHORT)
    if not long.isEmpty():
        grp = components(long.select(F.col("value").alias("a"), F.col("node").alias("b"))).select(
            "node", F.col("root").alias("grp")
        )
        members = long.select("node", "label").distinct().join(grp, "node").join(
            signatures.select("node", "size"), "node"
        )
        links = links.unionByName(joined_in_blocks(base.stored(members), sets, similarity))

    roots = components(links)
    lows = roots.join(nodes.select("node", "low"), "node")
    roots = lows.join(lows.groupBy("root").agg(F.min("low").alias("component_id")), "root").select(
        "node", "component_id"
    )
    of_node = nodes.select("node", "low").join(roots, "node", "left").select(
        "node", F.coalesce("component_id", "low").alias("component_id")
    )
    out = rows.select("doc_id", "n_shingles", "node").join(of_node, "node", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(base.table(spark, sf_dir, "documents"), 3, (85, 100))


QUERIES = {"op9_minhash_dedup": op9_minhash_dedup}
SQL = {
    "op9_minhash_dedup": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM words UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM words JOIN least ON a = doc_id LEFT JOIN sizes USING (doc_id)
""",
}
