"""Merkle manifest of a document table, and proofs of its rows by octopus multiproofs.

A row is a leaf. The leaves of a source, by doc_id, are a tree whose nodes are made from three consecutive ones (a last
run has fewer) until one is left, the subroot; the subroots by source are the leaves of one more tree, with number
``TOP``, whose root stands for the table. A node's coordinate is (tree, level, i).

Leaves lie in blocks of ``WIDTH``, a whole subtree each, so that most nodes are made inside one task, ``LEVELS`` levels
at a time. To prove leaves, a block computes the minimal union of the coordinates that its leaves do not derive
themselves (an octopus multiproof: siblings that several leaves lack are there once, and those that it can derive not at
all), fetches their digests in one join, derives the interiors that its leaves share, and expands one proof for each
leaf.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segjobs.functions.ranking import ranked
from segjobs.llm import base

ARITY = 3
LEVELS = 7
WIDTH = ARITY**LEVELS
TOP = -1
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes of the uppermost levels that all blocks may ask for: so many at most are broadcast, if small enough.
NEAR_ROOT = 100_000

_NODES = "tree bigint, level int, i bigint, digest string, top boolean"


def leaf(**fields: Column) -> Column:
    """The digest of a row: of ``FIELDS``, each from the column of that name unless given otherwise."""

    def coded(name: str) -> Column:
        value = fields.get(name, F.col(name)).cast("string")
        return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))

    return F.sha2(F.concat(*map(coded, FIELDS)), 256)


def hashed(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def parents(digests: list[str]) -> list[str]:
    return [hashed(digests[k : k + ARITY]) for k in range(0, len(digests), ARITY)]


def missing(present: np.ndarray, n: int) -> list[tuple[int, np.ndarray]]:
    """(level, i) of the nodes that, with the leaves at the places ``present``, are enough to derive a root of ``n``
    leaves."""
    out, level, known = [], 0, np.unique(present)
    while n > 1:
        runs = np.unique(known // ARITY)
        members = (runs[:, None] * ARITY + np.arange(ARITY)).ravel()
        lacked = np.setdiff1d(members[members < n], known, assume_unique=True)
        if len(lacked):
            out.append((level, lacked))
        level, known, n = level + 1, runs, -(-n // ARITY)
    return out


def derived(known: dict[tuple[int, int], str], present: np.ndarray, n: int) -> tuple[str, list[list[tuple[str, str]]]]:
    """The root from known digests by (level, i), and for each leaf of ``present`` its steps: what is hashed before and
    after it, level by level. Interiors and the steps above them are made once for all leaves below. known is added
    to."""
    levels, places, count = [], np.unique(present), n
    while count > 1:
        levels.append((places, count))
        level = len(levels)
        places, size = np.unique(places // ARITY), count
        for i in places.tolist():
            if (level, i) not in known:
                known[level, i] = hashed([known[level - 1, j] for j in range(i * ARITY, min(i * ARITY + ARITY, size))])
        count = -(-count // ARITY)
    above: dict[int, list[tuple[str, str]]] = {0: []}
    for level in range(len(levels) - 1, -1, -1):
        places, size = levels[level]
        here = {}
        for i in places.tolist():
            first = i // ARITY * ARITY
            run = [known[level, j] for j in range(first, min(first + ARITY, size))]
            here[i] = [("".join(run[: i - first]), "".join(run[i - first + 1 :])), *above[i // ARITY]]
        above = here
    return known[len(levels), 0], [above[i] for i in present.tolist()]


def fold(digest: Column, steps: Column) -> Column:
    """The root that a leaf's digest and its steps give."""
    return F.aggregate(steps, digest, lambda a, s: F.sha2(F.concat(s["before"], a, s["after"]), 256))


def proof_digest(steps: Column) -> Column:
    """The digest of a proof: of its siblings, level by level."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def _nodes(blocks: DataFrame, level: int) -> DataFrame:
    """The nodes up to ``LEVELS`` above those of a level in blocks (tree, block, n, items of i and digest)."""

    def rows(batches):
        for batch in batches:
            out: list[tuple] = []
            for tree, block, n, items in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                digests = [x["digest"] for x in sorted(items, key=lambda x: x["i"])]
                at, count = block * WIDTH, n
                for up in range(1, LEVELS + 1):
                    if count <= 1:
                        break
                    digests, at, count = parents(digests), at // ARITY, -(-count // ARITY)
                    out += [(tree, level + up, at + k, d, count == 1) for k, d in enumerate(digests)]
            types = (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in out], t) for k, t in enumerate(types)], ["tree", "level", "i", "digest", "top"]
            )

    return blocks.select("tree", "block", "n", "items").mapInArrow(rows, _NODES)


def _blocks(rows: DataFrame, *item: str | Column) -> DataFrame:
    """tree, block, n, items of rows (tree, i, n and the items' fields); at most ``WIDTH`` items in a row."""
    kept = rows.withColumn("block", F.floor(F.col("i") / WIDTH).cast("long"))
    return kept.groupBy("tree", "block").agg(F.first("n").alias("n"), F.collect_list(F.struct(*item)).alias("items"))


def grown(blocks: DataFrame, most: int) -> DataFrame:
    """All nodes above the leaves in blocks, of which a tree has ``most`` at most. A round makes ``LEVELS`` levels."""
    made = [base.stored(_nodes(blocks, 0))]
    sizes = blocks.groupBy("tree").agg(F.first("n").alias("leaves"))
    level = 0
    while most > WIDTH:
        most, level = -(-most // WIDTH), level + LEVELS
        count = F.col("leaves")
        for _ in range(level):
            count = F.floor((count + (ARITY - 1)) / ARITY)
        above = sizes.select("tree", count.cast("long").alias("n")).where("n > 1")
        tops = made[-1].where(F.col("level") == level).join(base.small(above), "tree")
        made.append(base.stored(_nodes(_blocks(tops, "i", "digest"), level)))
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out


@dataclass(frozen=True)
class Manifest:
    """leaves: tree, block, n (leaves of the tree), items (i, doc_id, digest and extra fields); nodes: those above them.
    sources: tree, source, n, subroot. top: nodes of the tree of subroots, those themselves as level 0. root: None
    without rows."""

    leaves: DataFrame
    nodes: DataFrame
    sources: DataFrame
    top: DataFrame
    n_sources: int
    root: str | None


def manifest(docs: DataFrame, **extra: Column) -> Manifest:
    """The manifest of docs (columns ``FIELDS``; others are not read), with extra columns carried along with its leaves.

    Texts are read once and are not shuffled: only digests are ordered, by ranges of (source, doc_id, digest), so that a
    source of any size spreads over tasks. A null doc_id comes first in its source, and a null source before the others;
    rows of equal doc_id stand in the order of their digests, so that repeated rows are leaves of their own.
    """
    spark = docs.sparkSession
    rows = base.stored(docs.select("doc_id", "source", leaf().alias("digest"), *[c.alias(k) for k, c in extra.items()]))
    order = [F.col(c).asc_nulls_first() for c in ("source", "doc_id", "digest")]
    placed = ranked(rows, *order, name="place")
    by_source = placed.groupBy("source").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    sources = base.stored(
        ranked(by_source, F.col("source").asc_nulls_first(), name="k").withColumn("tree", F.col("k") - 1).drop("k")
    )
    n_sources, most = sources.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    named = sources.withColumnRenamed("source", "known")
    own = placed.join(base.small(named), F.col("source").eqNullSafe(F.col("known"))).withColumn(
        "i", F.col("place") - F.col("first")
    )
    leaves = base.stored(_blocks(own, "i", "doc_id", "digest", *extra))
    nodes = grown(leaves, most)
    single = leaves.where("n = 1").select("tree", F.col("items")[0]["digest"].alias("subroot"))
    subroots = nodes.where("top").select("tree", F.col("digest").alias("subroot")).unionByName(single)
    sources = base.stored(sources.select("tree", "source", "n").join(base.small(subroots), "tree"))
    lowest = sources.select(
        F.lit(TOP).cast("long").alias("tree"),
        F.lit(0).alias("level"),
        F.col("tree").alias("i"),
        F.col("subroot").alias("digest"),
        F.lit(n_sources == 1).alias("top"),
    )
    above = grown(_blocks(lowest.withColumn("n", F.lit(n_sources)), "i", "digest"), n_sources)
    top = base.stored(lowest.unionByName(above))
    found = top.where("top").select("digest").head()
    return Manifest(leaves, nodes, sources, top, n_sources, found[0] if found else None)


def _wanted(blocks: DataFrame, n_sources: int) -> DataFrame:
    """(tree, block, at_tree, at_level, at): the coordinates that each block of leaves has to fetch."""

    def rows(batches):
        for batch in batches:
            out = []
            for tree, block, n, places in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                found = [(tree, level, at) for level, at in missing(np.array(places, np.int64), n)]
                found += [(TOP, level, at) for level, at in missing(np.array([tree]), n_sources)]
                out += [(tree, block, t, level, i) for t, level, at in found for i in at.tolist()]
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in out], t) for k, t in enumerate(types)],
                ["tree", "block", "at_tree", "at_level", "at"],
            )

    return blocks.select("tree", "block", "n", "items.i").mapInArrow(
        rows, "tree bigint, block bigint, at_tree bigint, at_level int, at bigint"
    )


def _fetched(m: Manifest, wanted: DataFrame) -> DataFrame:
    """wanted with digests. The few nodes near roots, for which many blocks ask, are broadcast; of others, a node is
    asked for by few blocks."""
    nodes = m.nodes.unionByName(m.top)
    low = wanted.where(f"at_level = 0 AND at_tree <> {TOP}")
    if not low.isEmpty():  # some leaves of a run are proved without the others
        nodes = nodes.unionByName(
            m.leaves.select("tree", F.explode("items").alias("x")).select(
                "tree", F.lit(0).alias("level"), "x.i", "x.digest", F.lit(False).alias("top")
            )
        )
    nodes = nodes.select(
        F.col("tree").alias("at_tree"), F.col("level").alias("at_level"), F.col("i").alias("at"), "digest"
    )
    is_top = F.col("at_tree") == TOP
    sizes = nodes.groupBy(is_top.alias("is_top"), "at_level").count().orderBy("count").collect()  # a row a level
    near, total = [], 0
    for r in sizes:
        total += r["count"]
        if total <= NEAR_ROOT:
            near.append(2 * r["at_level"] + r["is_top"])
    close = (2 * F.col("at_level") + is_top.cast("int")).isin(near)
    on = ["at_tree", "at_level", "at"]
    found = wanted.where(close).join(base.small(nodes.where(close)), on)
    return found.unionByName(nodes.where(~close).join(base.small(wanted.where(~close)), on).select(*found.columns))


def proofs(m: Manifest, only: Callable[[Column], Column] | None = None) -> DataFrame:
    """The fields of m's leaves (i, doc_id, digest, extra ones), tree, subroot, root and steps (before, after): a proof
    of each leaf, or of those for whose item ``only`` holds. fold() gives the root again; siblings are what before and
    after hold.
    """
    blocks = m.leaves
    if only is not None:
        blocks = base.stored(blocks.withColumn("items", F.filter("items", only)).where("size(items) > 0"))
    wanted = base.stored(_wanted(blocks, m.n_sources))
    got = _fetched(m, wanted).groupBy("tree", "block").agg(
        F.collect_list(F.struct("at_tree", "at_level", "at", "digest")).alias("got")
    )
    joined = blocks.join(base.small(base.stored(got)), ["tree", "block"], "left").select("tree", "n", "items", "got")
    item = blocks.schema["items"].dataType.elementType
    n_sources = m.n_sources

    def rows(batches):
        pair = pa.struct([("before", pa.string()), ("after", pa.string())])
        for batch in batches:
            for k in range(batch.num_rows):
                tree, n = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                items = batch.column(2)[k].values
                places = items.field("i").to_numpy()
                own, top = {}, {}
                for x in batch.column(3)[k].as_py() or []:
                    (top if x["at_tree"] == TOP else own)[x["at_level"], x["at"]] = x["digest"]
                own.update(zip(((0, i) for i in places.tolist()), items.field("digest").to_pylist(), strict=True))
                subroot, steps = derived(own, places, n)
                top[0, tree] = subroot
                root, upper = derived(top, np.array([tree]), n_sources)
                upper = upper[0]
                size = [len(s) + len(upper) for s in steps]
                flat = [x for s in steps for x in (*s, *upper)]
                pairs = pa.StructArray.from_arrays(
                    [pa.array([x[j] for x in flat], pa.string()) for j in (0, 1)], fields=list(pair)
                )
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *size]), pa.int32()), pairs)
                same = [
                    pa.array([v] * len(items), t)
                    for v, t in ((tree, pa.int64()), (subroot, pa.string()), (root, pa.string()))
                ]
                fields = [items.field(j) for j in range(items.type.num_fields)]
                yield pa.RecordBatch.from_arrays(
                    [*fields, *same, lists], [*(f.name for f in items.type), "tree", "subroot", "root", "steps"]
                )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in item.fields)
    return joined.mapInArrow(
        rows, f"{schema}, tree bigint, subroot string, root string, steps array<struct<before:string,after:string>>"
    )


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents")
    tampered = F.when(
        F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))
    ).otherwise(F.col("text"))
    proved = proofs(manifest(docs, claimed=leaf(text=tampered)))
    folded = proved.withColumn("folded_root", fold(F.col("claimed"), F.col("steps")))
    return folded.select(
        "doc_id",
        F.col("digest").alias("leaf"),
        "subroot",
        "root",
        proof_digest(F.col("steps")).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


QUERIES = {"op12_merkle_manifest": op12_merkle_manifest}

_SQL = """WITH RECURSIVE crc AS (  -- of a doc_id's digits: -1 stands for a shift by a bit
  SELECT doc_id, xor(list_reduce([4294967295] || flatten([[unicode(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] for c in string_split(doc_id::VARCHAR, '')]),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295) AS crc
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)),
coded AS (SELECT d.doc_id, source, FIELD(d.doc_id) || FIELD(source) || FIELD(lang) || FIELD(n_chars) AS head, text, CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS other FROM documents d LEFT JOIN crc USING (doc_id)),
leaves AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM (SELECT doc_id, source, sha256(head || FIELD(text)) AS leaf, sha256(head || FIELD(other)) AS claimed FROM coded)),
nodes(source, level, i, digest) AS (SELECT source, 0, i, leaf FROM leaves UNION ALL
  SELECT source, level + 1, i // 3, sha256(string_agg(digest, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY source) AS n FROM nodes) WHERE n > 1 GROUP BY source, level, i // 3),
heads AS (SELECT source, level AS depth, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS s FROM (SELECT *, max(level) OVER (PARTITION BY source) AS depth FROM nodes) WHERE level = depth),
upper(level, i, digest) AS (SELECT 0, s, subroot FROM heads UNION ALL
  SELECT level + 1, i // 3, sha256(string_agg(digest, '' ORDER BY i)) FROM (SELECT *, count(*) OVER () AS n FROM upper) WHERE n > 1 GROUP BY level, i // 3),
tops AS (SELECT digest AS root, level AS height FROM upper ORDER BY level DESC LIMIT 1),
steps AS (  -- what is hashed before and after each node, by source (upper: by s) and level
  SELECT s, a.level, a.i, coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS before, coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS after
    FROM nodes a JOIN heads h ON a.source IS NOT DISTINCT FROM h.source JOIN nodes b ON a.source IS NOT DISTINCT FROM b.source AND a.level = b.level AND a.i // 3 = b.i // 3 WHERE a.level < depth GROUP BY ALL
  UNION ALL SELECT -1, a.level, a.i, coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (b.i < a.i), ''), coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (b.i > a.i), '')
    FROM upper a JOIN tops ON a.level < height JOIN upper b ON a.level = b.level AND a.i // 3 = b.i // 3 GROUP BY ALL),
walk(doc_id, leaf, subroot, s, depth, tree, level, i, digest, proof) AS (
  SELECT doc_id, leaf, subroot, h.s, depth, CASE WHEN depth = 0 THEN -1 ELSE h.s END, 0, CASE WHEN depth = 0 THEN h.s ELSE l.i END, claimed, '' FROM leaves l JOIN heads h ON l.source IS NOT DISTINCT FROM h.source
  UNION ALL SELECT doc_id, leaf, subroot, w.s, depth, CASE WHEN w.tree >= 0 AND w.level + 1 = depth THEN -1 ELSE w.tree END, CASE WHEN w.tree >= 0 AND w.level + 1 = depth THEN 0 ELSE w.level + 1 END,
    CASE WHEN w.tree >= 0 AND w.level + 1 = depth THEN w.s ELSE w.i // 3 END, sha256(before || digest || after), proof || before || after FROM walk w JOIN steps t ON t.s = w.tree AND t.level = w.level AND t.i = w.i)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, digest AS folded_root, digest = root AS verified FROM walk JOIN tops ON tree = -1 AND level = height"""


def _sql() -> str:
    import re

    return re.sub(r"FIELD\(([\w.]+)\)", r"coalesce(strlen(\1::VARCHAR) || ':' || \1::VARCHAR, '-')", _SQL)


SQL = {"op12_merkle_manifest": _sql()}
