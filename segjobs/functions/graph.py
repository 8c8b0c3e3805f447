"""Connected components by rounds of joins, for graphs of any size and with hubs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segjobs.functions.shared import discard, stored

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b: bigint); root is the least node reachable.

    Alternating stars: in the first half of a round each node hands its least neighbour to its larger ones, in
    the second to its smaller ones and itself; rounds grow as the logarithm of the longest path. Each
    round is written to the shared folder, and the one before it deleted. A hub's rows meet in a join, which adaptive
    execution can split. Self-loops and repeated edges are harmless; an empty table gives no rows.
    """
    edges = stored(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    )
    before = None
    for _ in range(MAX_ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = small.unionByName(least.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        last, edges = edges, stored(after)
        discard(last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit(0xFFFFFFFF)))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots).distinct()
