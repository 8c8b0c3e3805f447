"""URL filters: allow and block rules, and for other URLs boosted trees on lexical features.

Only DataFrame operations and Spark's own trees. The trees are fitted on at most ``MAX_FIT`` labelled URLs: a page's URL
ends its path with the number of its document, and is bad if that document is labelled toxic or of poor quality. A
URL's suffix statistics, its host's last two labels' share of bad ones, come from other labelled URLs than those the
trees see it with: each of ``FOLDS`` parts has those of the other parts, and URLs to be judged those of all. A URL is
blocked by the trees if they hold bad for likelier.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segjobs.llm import base

# The rules of the query.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
MAX_FIT, FOLDS = 20_000, 5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = (
    "url_length",
    "host_length",
    "depth",
    "digit_ratio",
    "entropy",
    "n_params",
    "n_labels",
    "n_hyphens",
    "suffix_bad",
    "suffix_count",
)


def parsed(pages: DataFrame) -> DataFrame:
    """pages with host (A-Z lower-cased) and path; both empty for null URLs and those without ``://``."""
    rest = F.when(F.instr("url", "://") > 0, F.expr("substr(url, instr(url, '://') + 3)")).otherwise("")
    pages = pages.drop("host", "path").withColumn(
        "host", F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    )
    return pages.withColumn("path", F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def ruled(pages: DataFrame, rules=RULES) -> DataFrame:
    """pages (host, path) with rule and its verdict, null where none fits. A rule is a host, which stands for its
    subdomains too, and the start of a path; the longest that fits wins. For a short list: one expression, no join."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        host, _, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(f"/{path}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return pages.withColumn("rule", rule).withColumn("verdict", verdict)


def lexical(pages: DataFrame) -> DataFrame:
    """pages (url, host, path) with the features that depend on the URL alone, and suffix, the host's last two
    labels."""
    url, n = F.coalesce("url", F.lit("")), F.greatest(F.length("host"), F.lit(1))
    letters = "array_remove(split(host, ''), '')"
    entropy = f"aggregate(array_distinct({letters}), 0D, (a, c) -> a - (length(host) - length(replace(host, c, ''))) / length(host) * log2((length(host) - length(replace(host, c, ''))) / length(host)))"
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return pages.withColumns({
        "suffix": F.regexp_extract("host", r"[^.]*(?:\.[^.]*)?$", 0),
        "url_length": F.length(url).cast("double"),
        "host_length": F.length("host").cast("double"),
        "depth": F.size(F.expr("filter(split(path, '/'), x -> x <> '')")).cast("double"),
        "digit_ratio": F.length(F.regexp_replace(url, "[^0-9]", "")) / F.greatest(F.length(url), F.lit(1)),
        "entropy": F.coalesce(F.expr(entropy), F.lit(0.0)),
        "n_params": F.when(query == "", 0.0).otherwise(F.size(F.split(query, "&")).cast("double")),
        "n_labels": F.size(F.split("host", r"\.")).cast("double"),
        "n_hyphens": (F.length("host") - F.length(F.replace("host", F.lit("-"), F.lit("")))).cast("double"),
    })


def labelled(pages: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT) -> DataFrame:
    """url, host, path, bad (1.0 or 0.0) and fold of at most ``max_fit`` distinct labelled URLs, chosen by a hash.

    pages: url, host, path; labels: doc_id, quality, toxic. Rows without a URL, and labels without a doc_id, count for
    nothing; a null quality or toxic says nothing bad; of a document's several labels the worst holds.
    """
    own = pages.where("url IS NOT NULL").select("url", "host", "path")
    own = own.withColumn("of", F.expr("try_cast(regexp_extract(path, '([0-9]{1,18})[^0-9]*$', 1) AS BIGINT)"))
    poor = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("of")).agg(
        F.max(poor.cast("double")).alias("bad")
    )
    found = own.join(base.small(known), "of").select("url", "host", "path", "bad").distinct()  # of labelled URLs alone
    rows = found.withColumn("fold", F.pmod(F.xxhash64("url", F.lit("fold")), F.lit(FOLDS)))
    return rows.orderBy(F.xxhash64("url"), "url", "bad").limit(max_fit)


def with_suffixes(pages: DataFrame, sums: DataFrame, on: list[str]) -> DataFrame:
    """pages with the suffix statistics: share of bad ones, drawn towards that of all by two rows, and how many.
    ``sums`` has at most ``FOLDS`` rows for each suffix among the labelled URLs, so it can be broadcast."""
    joined = pages.join(base.small(sums), on, "left")
    share = (F.coalesce("bad_sum", F.lit(0.0)) + 2 * F.coalesce("prior", F.lit(0.5))) / (
        F.coalesce("many", F.lit(0)) + 2
    )
    return joined.withColumns(
        {"suffix_bad": share, "suffix_count": F.log1p(F.coalesce("many", F.lit(0)).cast("double"))}
    )


class UrlTrees:
    """Boosted trees over FEATURES. Without labelled URLs of both kinds there are none, and every URL is allowed."""

    def __init__(self, model=None, sums: DataFrame | None = None):
        self.model, self.sums = model, sums

    @classmethod
    def fit(
        cls, pages: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT, rounds: int = 12, depth: int = 4
    ) -> UrlTrees:
        sample = base.stored(lexical(labelled(pages, labels, max_fit)))
        prior = sample.agg(F.min("bad"), F.max("bad"), F.avg("bad")).first()
        if prior[0] is None or prior[0] == prior[1]:
            return cls()
        totals = sample.groupBy("suffix").agg(F.sum("bad").alias("bad_sum"), F.count("*").alias("many"))
        totals = base.stored(totals.withColumn("prior", F.lit(prior[2])))
        by_fold = sample.groupBy("suffix", "fold").agg(F.sum("bad").alias("own_bad"), F.count("*").alias("own_many"))
        others = by_fold.join(totals, "suffix").select(
            "suffix", "fold", (F.col("bad_sum") - F.col("own_bad")).alias("bad_sum"), (
                F.col("many") - F.col("own_many")
            ).alias("many"), "prior",
        )
        rows = with_suffixes(sample, base.stored(others), ["suffix", "fold"])
        ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).select(
            "features", F.col("bad").alias("label")
        )
        return cls(GBTClassifier(maxIter=rounds, maxDepth=depth, maxBins=32, seed=7).fit(ready), totals)

    def bad(self, pages: DataFrame) -> DataFrame:
        """pages (url, host, path) with p_bad, the trees' chance that the URL is bad."""
        if self.model is None:
            return pages.withColumn("p_bad", F.lit(0.0))
        own = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("page"), "url", "host", "path")
        rows = with_suffixes(lexical(own), self.sums, ["suffix"])
        ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
        return self.model.transform(ready).select("page.*", vector_to_array("probability")[1].alias("p_bad"))


def judged(pages: DataFrame, trees: UrlTrees, rules=RULES) -> DataFrame:
    """pages with host, path, rule, p_bad and verdict (allow or block). Row by row: nothing is shuffled.

    A null URL or one without ``://`` has an empty host and path, and no rule; the trees judge it. Repeated rows are
    judged alike; other columns stay, except that columns named as the new ones are replaced.
    """
    out = trees.bad(ruled(parsed(pages.drop("rule", "verdict", "p_bad")), rules))
    return out.withColumn("verdict", F.coalesce("verdict", F.when(F.col("p_bad") >= 0.5, "block").otherwise("allow")))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = base.table(spark, sf_dir, "pages").select("page_id", "url")
    trees = UrlTrees.fit(parsed(pages), base.table(spark, sf_dir, "labels"))
    return judged(pages, trees).select("page_id", "host", "path", "rule", "verdict", F.round("p_bad", 9).alias("p_bad"))


QUERIES = {"op7_url_filter": op7_url_filter}
#: No SQL: DuckDB has no boosted trees; tests compare hosts, paths and rules with brute force and measure held-out
#: accuracy.
SQL: dict[str, str] = {}
