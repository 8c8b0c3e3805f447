"""A corpus from raw documents: rule out poor ones, drop near duplicates and leaked benchmarks, mask secrets, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segjobs.llm import base, decontamination, minhash, packing, quality_rules, secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and whose lines are content for the most part.

    A null, empty or wordless text has no words and goes, as any document of under 20 words does. Rows without a doc_id
    and repeated rows are judged each for itself, by their texts. Columns keep their values, whatever their names. An
    empty table stays empty; without labels, lines are told by the rules alone.
    """
    model = quality_rules.fit(docs, base.table(spark, sf_dir, "labels"))
    return quality_rules.rated(docs, model).where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates; shingles of five words, similarity 0.8.

    Rows of equal doc_id are one document, of which one row stays; rows without a doc_id stay as they are.
    """
    found = minhash.near_duplicates(docs.where(F.col("doc_id").isNotNull()), 5, (80, 100))
    by_id = found.groupBy("doc_id").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n_rows"))
    gone = base.stored(by_id.where("NOT kept OR n_rows > 1").withColumnRenamed("doc_id", "known_id"))
    marked = docs.join(base.small(gone), F.col("doc_id") == F.col("known_id"), "left")
    once = marked.where("n_rows IS NULL").select(*docs.columns)
    repeated = marked.where("kept AND n_rows > 1").select(*docs.columns).dropDuplicates(["doc_id"])
    return once.unionByName(repeated)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Texts decide, not ids: rows without a doc_id and repeated rows stay or go by their texts. Null, empty and wordless
    texts stay, as does everything if the benchmark is empty. Columns keep their values, whatever their names.
    """
    return decontamination.clean(docs, base.table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in text and n_chars as it is then. Null texts stay null, other columns as they
    are; an empty table stays empty."""
    import public_tokenizers

    masked = secrets.masked(docs, secrets.known_words(docs, public_tokenizers.path("byte_bpe_50k.json")))
    if "n_chars" in docs.columns:
        n_chars = F.length("text").cast(docs.schema["n_chars"].dataType)
        masked = masked.withColumn("n_chars", n_chars).select(*docs.columns)
    return masked


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents' token ids as pieces of sequences of at most 4,096 tokens. A null text is an empty one; rows
    without a doc_id and repeated rows are packed each for itself; an empty table gives no rows."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), (
        "mask_secrets", mask_secrets
    ),
    ("pack", pack),
]

#: Several stages cannot be expressed in SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again."""
    docs = base.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = base.stored(docs)
    return docs
