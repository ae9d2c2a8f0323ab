"""Tables read as the engine's inputs: an embedding of 64 values is a feature map of 4 channels, 4 rows and 4 columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.shared import read

SHAPE = (4, 4, 4)


def maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``image_id``, ``data``, ``label`` and ``class``: labels under 8 are normal."""
    rows = read(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("image_id"), F.col("embedding").alias("data"), "label", F.when(F.col("label") < 8, "OK").otherwise("NG").alias("class"))


def bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All normal vectors: ``bank_id``, ``emb``."""
    return maps(spark, sf_dir).where("class = 'OK'").select(F.col("image_id").alias("bank_id"), F.col("data").alias("emb"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All maps as vectors: ``image_id`` and ``emb``."""
    return maps(spark, sf_dir).select("image_id", F.col("data").alias("emb"))
