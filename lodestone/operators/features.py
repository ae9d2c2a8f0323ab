"""Feature maps to patch vectors: fusion of layers, downscale, neighbourhood mean, flattening.

A map is an array in channel, row, column order. Rows are independent, so all of it is one pass over Arrow
batches without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from lodestone.functions.maps import bilinear
from lodestone.functions.vectors import matrix
from lodestone.plans.progress import untimed
from lodestone.shared import ship


def block_means(maps: np.ndarray, factor: int) -> np.ndarray:
    """Means of factor x factor blocks of maps (n, c, h, w); both sides must be divisible."""
    if factor <= 1:
        return maps
    n, c, h, w = maps.shape
    if h % factor or w % factor:
        raise ValueError(f"a map of {h} x {w} can't be scaled down by {factor}")
    return maps.reshape(n, c, h // factor, factor, w // factor, factor).mean(axis=(3, 5))


def neighbourhood_means(maps: np.ndarray, size: int) -> np.ndarray:
    """Means over the part of a size x size window that is inside the map, stride 1."""
    n, c, h, w = maps.shape
    half = size // 2
    total, count = np.zeros_like(maps, dtype=np.float64), np.zeros((h, w))
    for dy in range(-half, half + 1):
        for dx in range(-half, half + 1):
            here = slice(max(0, -dy), min(h, h - dy)), slice(max(0, -dx), min(w, w - dx))
            there = slice(max(0, dy), min(h, h + dy)), slice(max(0, dx), min(w, w + dx))
            if here[0].start < here[0].stop and here[1].start < here[1].stop:
                total[:, :, here[0], here[1]] += maps[:, :, there[0], there[1]]
                count[here] += 1
    return total / count


def patches(df: DataFrame, id_col: str = "image_id", data_col: str = "data", shape: tuple[int, int, int] = (4, 4, 4), patch_size: int = 1, downscale: int = 1, times=untimed) -> DataFrame:
    """Per map and position: the id, ``patch_idx`` (row by row), ``y``, ``x`` and ``emb`` (double), after downscaling and averaging.

    An empty or null map, or one of another size than ``shape``, is an error.
    """
    ship(df.sparkSession)
    c, h, w = shape

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = matrix(batch.column(1))
            if batch.column(1).null_count or flat.shape[1] != c * h * w:
                raise ValueError(f"a map must have {c} x {h} x {w} values")
            with times("downscale"):
                maps = block_means(flat.astype(np.float64).reshape(-1, c, h, w), downscale)
            with times("aggregate"):
                maps = neighbourhood_means(maps, patch_size)
            n, _, hh, ww = maps.shape
            emb = np.ascontiguousarray(maps.transpose(0, 2, 3, 1)).reshape(-1)
            at = np.tile(np.arange(hh * ww, dtype=np.int32), n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(np.repeat(np.arange(n), hh * ww))), pa.array(at), pa.array(at // ww), pa.array(at % ww), pa.ListArray.from_arrays(pa.array(np.arange(0, len(emb) + 1, c, dtype=np.int32)), pa.array(emb))],
                names=[id_col, "patch_idx", "y", "x", "emb"],
            )

    return df.select(id_col, data_col).mapInArrow(run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, patch_idx int, y int, x int, emb array<double>")


def fused(df: DataFrame, near: str, near_shape: tuple[int, int, int], far: str, far_shape: tuple[int, int, int], projection: np.ndarray, bias: np.ndarray | None = None, out: str = "data") -> DataFrame:
    """The rows with ``out``: the map ``far`` brought to the rows and columns of ``near`` (bilinear, half-pixel centres), its channels behind those of ``near``, and ``projection`` (target, channels) at each point.

    Up-sampling is two small products and the projection one product for a whole Arrow batch; its size is the network's. A null map of either gives null.
    """
    ship(df.sparkSession)
    (c, h, w), (cc, hh, ww) = near_shape, far_shape
    projection = np.ascontiguousarray(projection, dtype=np.float64)
    if projection.shape[1] != c + cc:
        raise ValueError(f"{c} and {cc} channels don't fit a projection of {projection.shape[1]}")
    dense = lambda taps, n: np.array([[sum(x for p, x in row if p == j) for j in range(n)] for row in taps])
    rows, columns = dense(bilinear(h, hh), hh), dense(bilinear(w, ww), ww)
    shift = np.zeros(len(projection)) if bias is None else np.asarray(bias, dtype=np.float64)
    kept = [x for x in df.columns if x != out]

    def run(batches):
        for batch in batches:
            both = pc.and_(pc.is_valid(batch.column(0)), pc.is_valid(batch.column(1)))
            some = batch.filter(both)
            a, b = (matrix(some.column(k)).astype(np.float64) for k in (0, 1))
            if some.num_rows and (a.shape[1] != c * h * w or b.shape[1] != cc * hh * ww):
                raise ValueError(f"maps must have {c} x {h} x {w} and {cc} x {hh} x {ww} values")
            up = np.einsum("yi,ncij,xj->ncyx", rows, b.reshape(-1, cc, hh, ww), columns, optimize=True)
            every = np.concatenate([a.reshape(-1, c, h * w), up.reshape(-1, cc, h * w)], axis=1)
            flat = (projection @ every + shift[:, None]).reshape(-1)
            width = len(projection) * h * w
            ends = np.concatenate(([0], np.cumsum(both.to_numpy(zero_copy_only=False)))) * width
            made = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat), mask=pc.invert(both))
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], made], names=[*kept, out])

    schema = StructType([*(df.schema[x] for x in kept), StructField(out, ArrayType(DoubleType()))])
    return df.select(F.col(near), F.col(far), *kept).mapInArrow(run, schema)


def cells(df: DataFrame, id_col: str, data_col: str, height: int, width: int) -> DataFrame:
    """Every value of a map with its channel, row and column, by index arithmetic in the JVM."""
    at = F.col("pos")
    out = df.select(id_col, F.posexplode(data_col).alias("pos", "value"))
    return out.select(id_col, F.floor(at / (height * width)).cast("int").alias("c"), F.floor(at % (height * width) / width).cast("int").alias("y"), (at % width).cast("int").alias("x"), F.col("value").cast("double").alias("value"))


def score_map(df: DataFrame, id_col: str, height: int, width: int) -> DataFrame:
    """Per map: ``scores``, its patch scores (``patch_idx``, ``dist``) in order; a map with another number of patches is an error."""
    rows = df.groupBy(id_col).agg(F.transform(F.sort_array(F.collect_list(F.struct("patch_idx", "dist"))), lambda p: p["dist"]).alias("scores"))
    checked = F.when(F.size("scores") == height * width, F.col("scores")).otherwise(F.raise_error(F.lit("a score map has missing patches")))
    return rows.select(id_col, checked.alias("scores"))
