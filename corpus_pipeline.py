"""A corpus pipeline over documents: toxicity, exact dedup, near dedup, source mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. A stage sees all that its predecessor kept, as a table written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readqc.llm import exact_dedup, mixing, ngram_join, packing, toxicity
from readqc.llm.store import materialize, small_batches


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic; labels of every fifth doc_id (by CRC) stay unseen."""
    labels = small_batches(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.reject(docs, labels, F.crc32(F.col("doc_id").cast("string")) % 5 == 0)


def dedup_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the largest doc_id."""
    return exact_dedup.dedup(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents, the one with the least doc_id."""
    small_batches(spark)
    return ngram_join.dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, those of smaller sources up to twice, by tempered source shares."""
    return mixing.mix(docs, repetition=2.0).select(*(F.col(f"`{c}`") for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 words in batches of at most 32768, padded to one of 8 lengths. Batches are filled in order of
    a hash of doc_id, so each holds the sources by their weights in the mixture, and not one stretch of doc_ids."""
    return packing.pack(docs, max_len=2048, buckets=8, budget=32_768, order=F.xxhash64("doc_id"))


STAGES = [("toxicity", clean), ("exact_dedup", dedup_exact), ("near_dedup", dedup_near), ("mixing", mix_sources), ("packing", pack)]

#: The classifier of the first stage can't be written in SQL; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = small_batches(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs)
    return docs


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
