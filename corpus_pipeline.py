"""A training corpus from raw documents: quality, toxicity, near copies, packing.

Each stage takes (spark, docs, sf_dir), and all but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import packing, quality_classifier, simhash, toxicity
from lodestone.llm._common import crc_of_id, read
from lodestone.shared import removed, shared_folder


def _passing(docs: DataFrame, score: Callable[[DataFrame], DataFrame], rejected: int) -> DataFrame:
    """The documents whose own judgement is not ``rejected``: ``score`` judges rows by ``row``, which holds a document's columns."""
    judged = score(docs.select(F.struct(*docs.columns).alias("row"), "text"))
    return judged.where(F.col("predicted") != rejected).select("row.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    labels = read(spark, sf_dir, "labels")
    weights = quality_classifier.train(docs, labels.where(crc_of_id("doc_id") % 5 != 0))
    return _passing(docs, lambda rows: quality_classifier.score(rows, weights, "row"), 0)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the toxicity lexicon rejects."""
    labels = read(spark, sf_dir, "labels")
    lexicon, curve = toxicity.learn(docs, labels.where(crc_of_id("doc_id") % 4 != 2))
    return _passing(docs, lambda rows: toxicity.score(rows, lexicon, curve, "row"), 1)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return simhash.deduplicated(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of tokens: the pieces of ``packing.pack``."""
    return packing.pack(docs)


STAGES = [("quality_classifier", quality), ("toxicity", clean), ("simhash_near_dedup", distinct), ("harmonic_packing", packed)]

#: No stage can be put in SQL: learnt weights, fingerprints and token ids. tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage; each stage's rows are written as Parquet in the shared folder and read again.

    A stage's rows are removed when the next one's are written; those that the result is read from stay, for the caller to remove.
    """
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                removed(spark, f"{folder}/{k - 1}")
    return docs
