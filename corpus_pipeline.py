"""The corpus pipeline: toxicity, exact dedup, n-gram Jaccard join, personal data, best-fit packing.

Each stage reads what the one before it kept, as Parquet in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rillstone.llm import exact_dedup, jaccard_join, packing, pii, toxicity
from rillstone.storage import delete, scratch, shared_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the toxicity model doesn't reject; it learns from labelled rows of its own input.

    Null and empty texts have the score of a text without words; repeated rows are judged alike.
    """
    return toxicity.reject_toxic(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest, then the least id; null ids come last. All empty and null texts are one group."""
    return exact_dedup.keep_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of a 5-word Jaccard similarity of 0.8 or more hold together: that with the least id.

    Texts without a word, null ones too, belong to no group and stay.
    """
    return jaccard_join.keep_one(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; personal data is replaced by its kind, and n_chars follows. Null texts stay null."""
    return pii.redact(docs)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their bins; empty and null texts have one piece without a bin."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("personal_data", redact_personal_data),
    ("packing", pack_documents),
]

#: The model, the sampled paths and the packing have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the last stage packs.

    A stage's own tables go when its result is written, and a result when the next one is, so
    the shared folder holds at most two results at a time, and the last one in the end.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        path = shared_dir(spark)
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
