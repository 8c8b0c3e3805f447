"""Benchmark decontamination with DataFrame operations only.

Texts are lower-cased words of letters and digits. A document's window as long as a benchmark item, in words, is
compared with it, at every start, over SimHash fingerprints: those within ``RADIUS`` bits are found by ``BLOCKS`` blocks
of the fingerprint. Of two within the radius, one block differs in at most ``RADIUS // BLOCKS`` bits, so each item is
listed under all such values of each block and no pair is missed. A window looks up its blocks among the items of its
length: at these sizes it meets an unlike item in 1.16 rows (eight blocks, each of which lists an item under 37 of 256
values), and one in 60 of them is within the radius. Pairs within it are verified by the exact weighted similarity of
their shingles, each weighted by its letters.

Windows that cannot be similar to any item are left out first. Of an item, the shingles that fewest items have and
that weigh more than ``1 - SIMILARITY`` of it together are looked for in all texts; a text without any of them has no
similar window. In texts that have one, running sums over what they share with the item leave those windows whose share
is too small. Both leave out windows only, and none that is similar, whatever the order of the passage: which item a
window is like is found by the blocks alone.

An item of fewer than ``SHINGLE`` words is one shingle, and could be found in any text; it is found only in documents
that have no other words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segjobs.llm import base

SHINGLE = 5
SIMILARITY = (80, 100)
#: At similarity 0.8 fingerprints differ in about 10 of 64 bits (deviation 3); 23 is over four deviations away.
RADIUS, BLOCKS = 23, 8

WORDS = r"array_remove(split(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), '')"


def _bound(value: str, name: str, of: str) -> str:
    """SQL for ``of``, in which ``name`` stands for value, evaluated once."""
    return f"transform(array({value}), {name} -> {of})[0]"


def _shingles(words: str) -> str:
    """SQL for the shingles (h: hash, s: text, w: weight) of an array of words; of fewer words the whole is one."""
    each = _bound(
        f"slice({words}, i + 1, {SHINGLE})",
        "g",
        "named_struct('s', array_join(g, ' '), 'w', CAST(length(array_join(g, '')) AS BIGINT))",
    )
    marked = f"transform(sequence(0, greatest(size({words}) - {SHINGLE}, 0)), i -> {_bound(each, 'x', _HASHED)})"
    return f"IF(size({words}) = 0, array(), {marked})"


_HASHED = "named_struct('h', xxhash64(x.s), 's', x.s, 'w', x.w)"

#: Hashes of the shingles of an array of words by place, the same for documents and items.
KEYS = f"""IF(size(ws) = 0, array(), IF(size(ws) < {SHINGLE}, array(xxhash64(array_join(ws, ' '), 0)), {_bound("transform(ws, x -> xxhash64(x))", "hs",
    f"transform(sequence(0, size(hs) - {SHINGLE}), i -> xxhash64({', '.join(f'hs[i + {k}]' for k in range(SHINGLE))}))")}))"""

FINGERPRINT = """aggregate(transform(sequence(0, 63), b -> IF(aggregate(sh, 0L, (a, x) -> a + IF(shiftright(x.h, b) & 1L = 1L, x.w, -x.w)) > 0,
    shiftleft(1L, b), 0L)), 0L, (x, y) -> x | y)"""

#: Weight common to the multisets sh and item_sh: each shingle as often as both have it.
COMMON = """aggregate(array_distinct(item_sh), 0L,
    (a, x) -> a + x.w * least(size(filter(item_sh, y -> y.h = x.h AND y.s = x.s)), size(filter(sh, y -> y.h = x.h AND y.s = x.s))))"""

_BITS = 64 // BLOCKS
_BLOCK = f"explode(transform(sequence(0, {BLOCKS - 1}), b -> named_struct('b', b, 'v', shiftright({{}}, b * {_BITS}) & {2**_BITS - 1}L)))"
_NEAR = f"explode(filter(sequence(0L, {2**_BITS - 1}L), m -> bit_count(m) <= {RADIUS // BLOCKS}))"


def items(benchmark: DataFrame) -> DataFrame:
    """item (a key of its id and words), item_id, n_words, ws, item_sh, item_weight and item_fp of the items with a
    word."""
    out = benchmark.select("item_id", F.expr(WORDS).alias("ws")).where(F.size("ws") > 0).distinct()
    out = out.withColumn("sh", F.expr(_shingles("ws")))
    item = F.xxhash64("item_id", F.col("item_id").isNull(), "ws")
    weight = F.expr("aggregate(sh, 0L, (a, x) -> a + x.w)")
    return out.select(
        item.alias("item"), "item_id", F.size("ws").alias("n_words"), "ws", F.col("sh").alias("item_sh"),
        weight.alias("item_weight"), F.expr(FINGERPRINT).alias("item_fp"),
    )


def hashes_of(wanted: DataFrame) -> DataFrame:
    """item, n_words, item_weight, hash, w and rare of the distinct shingles of items. Rare ones are had by the fewest
    items, and just enough to weigh more than what a similar window may lack."""
    rows = wanted.select(
        "item",
        "n_words",
        "item_weight",
        F.expr(f"inline(zip_with({KEYS}, item_sh, (k, x) -> named_struct('hash', k, 'w', x.w)))"),
    )
    own = rows.groupBy("item", "n_words", "item_weight", "hash").agg(F.max("w").alias("w"), F.sum("w").alias("all"))
    own = own.withColumn("n_items", F.count("*").over(Window.partitionBy("hash")))
    before = F.sum("all").over(Window.partitionBy("item").orderBy("n_items", "hash")) - F.col("all")
    num, den = SIMILARITY
    return own.select(
        "item",
        "n_words",
        "item_weight",
        "hash",
        "w",
        (den * before <= (den - num) * F.col("item_weight")).alias("rare"),
    )


def candidates(words: DataFrame, hashes: DataFrame) -> DataFrame:
    """(key, item) of texts (key, ws) that have one of the item's rare shingles."""
    rare = hashes.where("rare").select("item", "hash")
    return words.select("key", F.explode(F.array_distinct(F.expr(KEYS))).alias("hash")).join(
        base.small(rare), "hash"
    ).select("key", "item").distinct()


def windows(texts: DataFrame, likely: DataFrame, hashes: DataFrame) -> DataFrame:
    """key, start and n_words of the windows of texts (key, ws; each key once) that may be similar to an item of their
    length."""
    items_of = hashes.groupBy("item", "n_words", "item_weight").agg(
        F.map_from_entries(F.collect_list(F.struct("hash", "w"))).alias("weights")
    )
    own = texts.select("key", F.size("ws").alias("n"), F.expr(KEYS).alias("hashes")).join(likely, "key").join(
        base.small(items_of), "item"
    )
    # A shared shingle counts in the windows from its first start to its own place.
    found = own.select(
        "key",
        "n",
        "item",
        "n_words",
        "item_weight",
        F.expr(
            "inline(filter(transform(hashes, (h, i) -> named_struct('at', i, 'w', weights[h])), x -> x.w IS NOT NULL))"
        ),
    )
    first = f"greatest(0, at + least({SHINGLE}, n_words) - n_words)"
    ends = f"inline(array(named_struct('start', {first}, 'w', w), named_struct('start', at + 1, 'w', -w)))"
    marks = found.select("key", "n", "item", "n_words", "item_weight", F.expr(ends))
    num, den = SIMILARITY
    by = Window.partitionBy("key", "n", "item", "n_words", "item_weight").orderBy("start")
    last = F.least(F.lead("start").over(by) - 1, F.greatest(F.lit(0), F.col("n") - F.col("n_words")))
    runs = marks.withColumns({"shared": F.sum("w").over(by), "last": last})
    runs = runs.where((den * F.col("shared") >= num * F.col("item_weight")) & (F.col("start") <= F.col("last")))
    return runs.select("key", F.explode(F.sequence("start", "last")).alias("start"), "n_words").distinct()


def all_windows(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """windows() with none left out: every start, for the length of every item."""
    own = texts.select("key", F.size("ws").alias("n")).join(base.small(wanted.select("n_words").distinct()))
    own = own.where(f"n > 0 AND (n_words >= {SHINGLE} OR n < {SHINGLE})")
    return own.select(
        "key",
        F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("n") - F.col("n_words")))).alias("start"),
        "n_words",
    )


def near_items(prints: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, start, n_words, item) of windows (with fp) and items of their length within RADIUS bits, over blocks."""
    index = wanted.select("item", "n_words", "item_fp", F.expr(_BLOCK.format("item_fp")).alias("x")).select(
        "*", F.expr(_NEAR).alias("m")
    )
    index = index.select(
        "item", "n_words", "item_fp", F.col("x.b").alias("b"), F.col("x.v").bitwiseXOR(F.col("m")).alias("v")
    )
    looked = prints.select("key", "start", "n_words", "fp", F.expr(_BLOCK.format("fp")).alias("x")).select(
        "key", "start", "n_words", "fp", "x.b", "x.v"
    )
    within = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS
    return looked.join(base.small(index), ["n_words", "b", "v"]).where(within).select(
        "key", "start", "n_words", "item"
    ).distinct()


def _leaks(docs: DataFrame, benchmark: DataFrame, all_starts: bool = False) -> DataFrame:
    """doc_id, key (a hash of the text), item_id and similarity_ppm of each text with a window similar to an item.
    all_starts: no window is left out before the fingerprints."""
    wanted = base.stored(items(benchmark))
    hashes = base.stored(hashes_of(wanted))
    keyed = F.xxhash64("text").alias("key")
    texts = docs.select("doc_id", "text", keyed)
    if not all_starts:
        likely = base.stored(candidates(docs.select(keyed, F.expr(WORDS).alias("ws")), hashes))
        texts = texts.join(base.small(likely.select("key").distinct()), "key", "left_semi")
    texts = base.stored(texts.withColumn("ws", F.expr(WORDS)))
    of_text = texts.groupBy("key").agg(F.first("ws").alias("ws"))
    places = base.stored(all_windows(of_text, wanted) if all_starts else windows(of_text, likely, hashes))
    own = ["key", "start", "n_words"]
    cut = of_text.join(places, "key").select(*own, F.expr("slice(ws, start + 1, n_words)").alias("ws"))
    cut = cut.select(*own, F.expr(_shingles("ws")).alias("sh"))
    prints = base.stored(cut.withColumn("fp", F.expr(FINGERPRINT)))

    num, den = SIMILARITY
    sure = near_items(prints, wanted).join(prints.select(*own, "sh"), own)
    sure = sure.join(base.small(wanted.select("item", "item_id", "item_sh", "item_weight")), "item")
    sure = sure.withColumn("common", F.expr(COMMON))
    sure = sure.withColumn("union", F.expr("item_weight + aggregate(sh, 0L, (a, x) -> a + x.w) - common"))
    ppm = F.max(F.floor(F.expr("1000000 * common / union"))).cast("bigint")
    best = sure.where(den * F.col("common") >= num * F.col("union")).groupBy("key", "item_id").agg(
        ppm.alias("similarity_ppm")
    )
    return texts.select("doc_id", "key").distinct().join(base.small(base.stored(best)), "key")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id and similarity_ppm of each document that has a window similar to an item; the best window's.

    docs: doc_id, text; benchmark: item_id, text; other columns are not read. Null, empty and wordless texts match
    nothing. A document of fewer words than an item is one window. Rows are looked at one by one; those of equal doc_id
    give one row with the best similarity, and so do those without a doc_id, whose doc_id is null here. Rows of null
    item_id are items too. Repeated rows change nothing; very long texts are read whole; an empty table gives no rows.
    """
    best = _leaks(docs, benchmark).groupBy("doc_id", "item_id")
    return best.agg(F.max("similarity_ppm").alias("similarity_ppm"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows whose text has a leak, whatever their doc_id; other rows, and all columns, stay."""
    found = base.stored(_leaks(docs, benchmark).select(F.col("key").alias("leaked")).distinct())
    marked = docs.withColumn("leaked_key_of_text", F.xxhash64("text"))
    return marked.join(base.small(found), F.col("leaked_key_of_text") == F.col("leaked"), "left_anti").select(
        *docs.columns
    )


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(base.table(spark, sf_dir, "documents"), base.table(spark, sf_dir, "benchmark"))


QUERIES = {"op5_decontamination": op5_decontamination}
#: Windows at every start that holds a shared shingle; in all others nothing is in common.
SQL = {
    "op5_decontamination": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (SELECT doc_id, len(w) AS n, unnest(range(0, len(w) - 4)) AS p, w FROM d),
ish AS (SELECT item_id, len(w) AS n_words, unnest(range(0, len(w) - 4)) AS p, w FROM i),
dk AS (SELECT doc_id, n, p, array_to_string(w[p + 1:p + 5], ' ') AS s FROM ds),
ik AS (SELECT item_id, n_words, p, array_to_string(w[p + 1:p + 5], ' ') AS s, length(array_to_string(w[p + 1:p + 5], '')) AS c FROM ish),
seen AS (SELECT DISTINCT doc_id, dk.n, dk.p, item_id, n_words FROM dk JOIN ik USING (s)),
places AS (SELECT DISTINCT doc_id, item_id, n_words, unnest(range(greatest(0, least(p + 5 - n_words, n - n_words)), greatest(0, least(p, n - n_words)) + 1)) AS start FROM
  seen),
ws AS (SELECT doc_id, item_id, start, w[start + 1:start + n_words] AS w FROM places JOIN d USING (doc_id)),
wk AS (SELECT doc_id, item_id, start, unnest(range(0, len(w) - 4)) AS p, w FROM ws),
wc AS (SELECT doc_id, item_id, start, array_to_string(w[p + 1:p + 5], ' ') AS s, min(length(array_to_string(w[p + 1:p + 5], ''))) AS c, count(*) AS n FROM wk GROUP BY ALL),
ic AS (SELECT item_id, s, min(c) AS c, count(*) AS n FROM ik GROUP BY ALL),
wt AS (SELECT doc_id, item_id, start, sum(c * n) AS total FROM wc GROUP BY ALL),
it AS (SELECT item_id, sum(c * n) AS total FROM ic GROUP BY ALL),
m AS (SELECT doc_id, item_id, start, sum(wc.c * least(wc.n, ic.n)) AS common FROM wc JOIN ic USING (item_id, s) GROUP BY ALL),
r AS (SELECT doc_id, item_id, common, wt.total + it.total - common AS whole FROM m JOIN wt USING (doc_id, item_id, start) JOIN it USING (item_id))
SELECT doc_id, item_id, max(floor(1000000 * common / whole))::BIGINT AS similarity_ppm FROM r WHERE 100 * common >= 80 * whole GROUP BY ALL
""",
}
