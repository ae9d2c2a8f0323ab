"""Scoring of feature maps as they arrive: an extension, stateless for each image."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lodestone.plans.pipeline import Scorer, predict
from lodestone.sources.models import Model


def score_stream(maps: DataFrame, model: Model, shape: tuple[int, int, int], output: str, checkpoint: str, manual_threshold: float | None = None) -> StreamingQuery:
    """Appends predictions for each micro-batch of a stream of (``image_id``, ``data``) to Parquet below ``output``, under the batch's number.

    A batch that is run again after a failure overwrites its own folder, so every image is scored once. The index, if any, is built once.
    """
    scorer = Scorer(model, shape)

    def batch(rows: DataFrame, number: int) -> None:
        predict(rows, model, shape, manual_threshold, scorer).write.mode("overwrite").parquet(f"{output}/batch={number}")

    return maps.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
