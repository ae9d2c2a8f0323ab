"""Image sources: scans, decoding, feature extraction."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import PurePath

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.images import preprocessed
from lodestone.functions.scalars import is_image
from lodestone.plans.progress import untimed
from lodestone.shared import ship

#: Runtimes in order of preference. Fixed values.
PROVIDERS = ["CUDAExecutionProvider", "DmlExecutionProvider", "CPUExecutionProvider"]


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Every image file below a folder (or the one file), by ``path`` in an order that ignores case. A missing path is an error."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return found.where(is_image(F.col("path"))).select("path", "length").orderBy(F.lower("path"), "path")


def calibration(spark: SparkSession, path: str, most: int = 100) -> DataFrame:
    """The first images of a scan, as calibration uses them."""
    return scan(spark, path).limit(most)


def decoded(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images: ``path``, ``height``, ``width`` and ``data`` (BGR bytes, row by row). An image that can't be read is an error."""
    read = spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", False).load(path).select("image.*")
    named = read.withColumn("path", F.col("origin")).where(is_image(F.col("origin")))
    bad = F.raise_error(F.concat(F.lit("the image can't be read: "), F.col("path")))
    return named.select(F.when(F.col("height") < 0, bad.cast("string")).otherwise(F.col("path")).alias("path"), "height", "width", F.col("nChannels").alias("channels"), "data")


Extractor = Callable[[np.ndarray], np.ndarray]


def block_statistics(channels: np.ndarray, side: int = 7) -> np.ndarray:
    """A deterministic stand-in for a network: block means and deviations of each channel, (n, 6, side, side)."""
    n, c, h, w = channels.shape
    cut = channels[:, :, : h // side * side, : w // side * side].reshape(n, c, side, h // side, side, w // side)
    return np.concatenate([cut.mean(axis=(3, 5)), cut.std(axis=(3, 5))], axis=1).astype(np.float32)


def providers(use_gpu: bool, device: int = 0) -> list:
    """The runtimes to try: those for a GPU first if one is wanted and at hand."""
    import onnxruntime

    there = set(onnxruntime.get_available_providers())
    wanted = PROVIDERS if use_gpu else PROVIDERS[-1:]
    return [p if p == PROVIDERS[-1] else (p, {"device_id": device}) for p in wanted if p in there]


@lru_cache(maxsize=2)
def _session(file: str, use_gpu: bool = False, device: int = 0):
    import onnxruntime

    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = options.inter_op_num_threads = 1  # tasks are the parallelism
    return onnxruntime.InferenceSession(file, options, providers=providers(use_gpu, device))


def forget_sessions() -> None:
    """Opens files anew from here on: one of them was written."""
    _session.cache_clear()


def model_metadata(file: str) -> dict[str, str]:
    """The metadata map of a model file."""
    return dict(_session(file).get_modelmeta().custom_metadata_map)


def model_facts(file: str) -> tuple[str, str]:
    """How a model file wants its images (``fused`` or ``standard``), and its precision (float32, float16 or int8).

    Its metadata say so under keys that end in ``_preprocess`` and ``_precision``. Without the latter, the endings of its name tell both.
    """
    meta = model_metadata(file)
    said = lambda end: next((v for k, v in sorted(meta.items()) if k.endswith(end)), None)
    mode = "fused" if said("_preprocess") == "fused" else "standard"
    known = {"fp16": "float16", "int8": "int8"}
    if said("_precision") is not None:
        return mode, known.get(said("_precision"), "float32")
    name = PurePath(file).name.lower()
    precision = next((p for end, p in reversed(known.items()) if f"_{end}" in name), "float32")
    return "fused" if "_fused" in name else mode, precision


@dataclass(frozen=True)
class OnnxExtractor:
    """A model file as an extractor, one session for each worker process; its output must have four axes."""

    file: str
    use_gpu: bool = False
    device: int = 0

    @property
    def mode(self) -> str:
        """The preprocessing that the file asks for."""
        return model_facts(self.file)[0]

    def __call__(self, channels: np.ndarray) -> np.ndarray:
        session = _session(self.file, self.use_gpu, self.device)
        out = session.run(None, {session.get_inputs()[0].name: channels})[0]
        if out.ndim != 4:
            raise ValueError("a feature extractor gives (batch, channels, height, width)")
        return out


def onnx_extractor(file: str, use_gpu: bool = False, device: int = 0) -> OnnxExtractor:
    return OnnxExtractor(str(file), use_gpu, device)


def shape_of(extract: Extractor, size: int) -> tuple[int, int, int]:
    """Channels, rows and columns of an extractor's maps, from one empty image; it also warms the session up."""
    return tuple(extract(np.zeros((1, 3, size, size), dtype=np.float32)).shape[1:])


def features(images: DataFrame, extract: Extractor = block_statistics, size: int = 224, mode: str | None = None, batch: int = 8, channels: int | None = None, times=untimed) -> DataFrame:
    """Per decoded image: ``image_id`` (its path), ``data`` (channel, row, column), ``c``, ``h``, ``w``.

    Images are prepared as ``mode`` says, or else as the extractor asks. An extractor that gives another number of
    ``channels`` than asked for is an error. ``times`` (``progress.StageTimes``) sums what preparing and extracting take.
    """
    ship(images.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        how = mode or getattr(extract, "mode", "standard")
        for frame in frames:
            for i in range(0, len(frame), batch):
                part = frame.iloc[i : i + batch]
                ready = []
                with times("preprocess"):
                    for h, w, c, data in zip(part["height"], part["width"], part["channels"], part["data"], strict=True):
                        pixels = np.frombuffer(data, dtype=np.uint8).reshape(h, w, c)
                        pixels = np.repeat(pixels, 3, axis=2) if c == 1 else pixels[:, :, :3]
                        ready.append(preprocessed(pixels, size, how))
                with times("extract"):
                    out = extract(np.stack(ready))
                _, c, h, w = out.shape
                if channels is not None and c != channels:
                    raise ValueError(f"the extractor gives {c} channels, the configuration and the model say {channels}")
                yield pd.DataFrame({"image_id": part["path"].to_numpy(), "data": list(out.reshape(len(part), -1).astype(np.float32)), "c": np.int32(c), "h": np.int32(h), "w": np.int32(w)})

    return images.select("path", "height", "width", "channels", "data").mapInPandas(run, "image_id string, data array<float>, c int, h int, w int")
