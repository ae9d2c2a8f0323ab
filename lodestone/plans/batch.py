"""Prediction of many images that can be stopped and taken up again.

Images are dealt into parts by their ids. A part is one job, whose rows are written as they are found; a part that is through has its
``_SUCCESS`` and isn't scored again. The jobs carry a tag: ``cancel`` interrupts the one that runs and lets no other begin, and what
was through stays.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Cancelled(Exception):
    """A batch was stopped before all its parts were through."""


def _there(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


class Batch:
    """``score`` over rows in parts, with results in ``folder``: the same rows, parts and folder take it up where it stopped."""

    def __init__(self, rows: DataFrame, score: Callable[[DataFrame], DataFrame], folder: str, parts: int = 8, id_col: str = "image_id"):
        self.spark, self.score, self.folder, self.parts = rows.sparkSession, score, folder.rstrip("/"), parts
        self.rows = rows.withColumn("_part", F.pmod(F.xxhash64(id_col), F.lit(parts)))
        self.tag = f"batch-{uuid.uuid4().hex}"
        self._stopped = threading.Event()

    def _path(self, part: int) -> str:
        return f"{self.folder}/{self.parts}-{part}"

    def done(self) -> list[int]:
        """The parts that are through."""
        return [k for k in range(self.parts) if _there(self.spark, f"{self._path(k)}/_SUCCESS")]

    def run(self, report: Callable[[int, int], None] | None = None) -> DataFrame:
        """Scores the parts that are left, and returns the rows of all; ``report`` hears after each part how many are through, and of how many."""
        through = self.done()
        context = self.spark.sparkContext
        for part in (k for k in range(self.parts) if k not in through):
            if self._stopped.is_set():
                raise Cancelled(f"{len(through)} of {self.parts} parts are through")
            context.addJobTag(self.tag)
            try:
                self.score(self.rows.where(F.col("_part") == part).drop("_part")).write.mode("overwrite").parquet(self._path(part))
            except Exception as failure:
                if self._stopped.is_set():
                    raise Cancelled(f"{len(through)} of {self.parts} parts are through") from failure
                raise
            finally:
                context.removeJobTag(self.tag)
            through.append(part)
            if report:
                report(len(through), self.parts)
        return self.spark.read.parquet(*(self._path(k) for k in range(self.parts)))

    def cancel(self) -> None:
        """Stops the batch, from any thread."""
        self._stopped.set()
        self.spark.sparkContext.cancelJobsWithTag(self.tag)
