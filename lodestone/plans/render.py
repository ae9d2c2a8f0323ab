"""Heatmaps of patch scores, written by the workers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.images import heatmap, png
from lodestone.functions.scalars import stem
from lodestone.plans.progress import untimed
from lodestone.shared import ship


def file_name(path, label, score):
    """``{stem}_{label}_{score with four decimals}.png``"""
    return F.format_string("%s_%s_%.4f.png", stem(path), label, score)


def heatmaps(images: DataFrame, scores: DataFrame, height: int, width: int, times=untimed) -> DataFrame:
    """Per image of both (``path``, ``height``, ``width``, ``data`` BGR) and (``path``, ``label``, ``score``, ``scores`` in order): ``name`` and ``content``, a PNG.

    Write the rows with any sink; the bytes stay on the workers.
    """
    ship(images.sparkSession)
    rows = images.select("path", "height", "width", "data").join(scores.select("path", "label", "score", "scores"), "path")

    def run(batches):
        for batch in batches:
            out = []
            for h, w, data, values in zip(*(batch.column(c).to_pylist() for c in ("height", "width", "data", "scores")), strict=True):
                with times("heatmap"):
                    out.append(png(heatmap(np.frombuffer(data, dtype=np.uint8).reshape(h, w, 3), np.array(values, dtype=float).reshape(height, width))))
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("name"), pa.array(out, pa.binary())], names=["path", "name", "content"])

    return rows.withColumn("name", file_name(F.col("path"), F.col("label"), F.col("score"))).mapInArrow(run, "path string, name string, content binary")


def normalised(scores: DataFrame, id_col: str = "image_id", value: str = "dist") -> DataFrame:
    """Each patch score over its image's range, 0 to 1; null where the range is at most 1e-8."""
    image = Window.partitionBy(id_col)  # no join with a second reading of the scores: these would be taken twice
    ended = scores.withColumns({"low": F.min(value).over(image), "high": F.max(value).over(image)})
    span = F.col("high") - F.col("low")
    return ended.withColumn("level", F.when(span > 1e-8, (F.col(value) - F.col("low")) / span)).drop("low", "high")
