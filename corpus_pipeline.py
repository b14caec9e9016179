"""From raw documents to packed sequences: quality, exact and near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``. All but the last return the columns of documents; a
document is a row, and rows that share a doc_id stand or fall together in the near-duplicate stage.

In every stage a null text counts as empty, other columns may be null and are carried, texts of any length are read whole, columns
beside those of documents are dropped, and an empty table gives no rows. Ties: of equal texts the row of the largest doc_id stays, of near copies that of the smallest.
Stages with Python tasks let Spark hand them rows in batches of at most 1,000 (a setting of the session), which bounds what both sides hold.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from llm import exact_dedup, packing, quality_cnn, secret_scan, simhash_dedup
from llm.common import small_batches, stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on this table's labelled rows open to learning, scores at 0.7 or more; empty texts have a score like others."""
    small_batches(spark)
    docs = docs.select(*COLUMNS)
    network = quality_cnn.fit(docs, table(spark, sf_dir, "labels"))
    return quality_cnn.score(docs, network, keep=COLUMNS).where("score >= 0.7").select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, that of the largest doc_id; null and empty texts are one text."""
    return exact_dedup.deduplicated(exact_dedup.DigestIndex.temporary(spark), docs.select(*COLUMNS))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least doc_id of each group: fingerprints of three-word shingles, linked at two differing bits or fewer.

    Rows with null ids are a group's document only where all ids of the group are null.
    """
    small_batches(spark)
    classes = simhash_dedup.near_duplicates(docs, max_distance=2, shingle=3)
    stays = classes.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("stays")).distinct()
    return docs.select(*COLUMNS).join(stays, F.col("doc_id").eqNullSafe(F.col("stays")), "left_semi")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark; n_chars is counted anew where the text changed."""
    small_batches(spark)
    before = docs.select(*COLUMNS)
    after = secret_scan.redacted(before.withColumn("_was", F.md5("text")))
    changed = ~F.md5("text").eqNullSafe(F.col("_was"))
    return after.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens: doc_id, start, length, ids, doc_tokens, sequence_id, offset."""
    small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).drop("key")


STAGES = [("quality", quality), ("exact_dedup", exact), ("simhash_dedup", near), ("secrets", secrets), ("packing", packed)]

#: A trained network decides in the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
