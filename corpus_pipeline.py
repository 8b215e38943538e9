"""From raw documents to token ids: quality, exact copies, near copies, benchmark passages, encoding."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from scriptorium.llm import bpe, cotraining, decontaminate, exact, simhash
from scriptorium.llm.common import table, work_folder
from scriptorium.llm.queries import BPE_FILE


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the co-trained classifier rejects."""
    return cotraining.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of equal texts."""
    return exact.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of linked fingerprints."""
    return simhash.drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a window of a benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, with their digests."""
    return bpe.encode(docs, BPE_FILE)


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: The classifier and the tokenizer have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each is written below the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = work_folder(spark, "corpus")
    for name, stage in STAGES:
        path = os.path.join(folder, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
