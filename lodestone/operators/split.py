"""Seeded splits of normal (OK) and anomalous (NG) images.

The shuffle is the order of ``md5(seed:id)``, so it needs no generator state and any engine can repeat it. A row's rank in it is
found without a global window: rows are counted by the first digits of the digest, which gives every digest prefix its offset, and
ranks are only counted inside a prefix.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.config import clamp

#: Leading hexadecimal digits of the digest that make a group: 4096 groups.
PREFIX = 3


def seeded(seed: int, id_: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), id_.cast("string")))


def ranked(df: DataFrame, id_col: str, seed: int) -> DataFrame:
    """Adds ``place``, the row's rank from 0 in the seeded order."""
    digest = seeded(seed, F.col(id_col))
    rows = df.select(F.struct(*df.columns).alias("row"), digest.alias("digest"), F.substring(digest, 1, PREFIX).alias("prefix"))  # a caller's columns keep to themselves
    counts = rows.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)  # over 4096 rows at most
    offsets = counts.select("prefix", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("prefix").orderBy("digest", F.col(f"row.{id_col}")))
    return rows.withColumn("inside", inside).join(F.broadcast(offsets), "prefix").select("row.*", (F.col("offset") + F.col("inside") - 1).alias("place"))


def ok_sizes(n: int, ratios: tuple[float, float, float]) -> tuple[int, int, int]:
    """Floors of the first two shares, the rest to the last; the first takes one from the tail if it is empty."""
    shares = [max(0.0, r) for r in ratios]
    total = sum(shares)
    shares = [r / total for r in shares] if total > 0 else [0.6, 0.2, 0.2]
    sizes = [math.floor(n * shares[0]), math.floor(n * shares[1])]
    sizes.append(n - sum(sizes))
    if n and not sizes[0]:
        donor = max(k for k in (1, 2) if sizes[k])
        sizes[donor] -= 1
        sizes[0] = 1
    return tuple(sizes)


def ng_sizes(n: int, tune: float) -> tuple[int, int, int]:
    first = math.floor(n * clamp(tune, 0.05, 0.95))
    return 0, first, n - first


def ok_count_sizes(n: int, train: int, tune: int) -> tuple[int, int, int]:
    if train < 1:
        raise ValueError("a count split needs a training image")
    a = min(n, train)
    b = min(n - a, max(0, tune))
    return a, b, n - a - b


def ng_count_sizes(n: int, tune: int) -> tuple[int, int, int]:
    b = min(n, max(0, tune))
    return 0, b, n - b


def cut(df: DataFrame, id_col: str, seed: int, sizes: tuple[int, int, int]) -> DataFrame:
    """Adds ``subset``: train, tune or test, by the rank in the seeded order."""
    a, b, _ = sizes
    return ranked(df, id_col, seed).withColumn("subset", F.when(F.col("place") < a, "train").when(F.col("place") < a + b, "tune").otherwise("test")).drop("place")


def split(df: DataFrame, id_col: str = "image_id", class_col: str = "class", seed: int = 42, ratios: tuple = (0.6, 0.2, 0.2), ng_tune: float = 0.5, counts: tuple[int, int, int] | None = None) -> DataFrame:
    """The rows with ``subset``. OK rows are shuffled by ``seed``, NG rows by the next one. ``counts`` (train, tune, NG tune) replaces the ratios.

    No OK row is an error; NG rows may be missing.
    """
    n = {r[0]: r[1] for r in df.groupBy(class_col).agg(F.count(F.lit(1))).collect()}
    ok, ng = n.get("OK", 0), n.get("NG", 0)
    if not ok:
        raise ValueError("there is no OK image")
    first = ok_count_sizes(ok, counts[0], counts[1]) if counts else ok_sizes(ok, ratios)
    second = ng_count_sizes(ng, counts[2]) if counts else ng_sizes(ng, ng_tune)
    return cut(df.where(F.col(class_col) == "OK"), id_col, seed, first).unionByName(cut(df.where(F.col(class_col) == "NG"), id_col, seed + 1, second))


def can_tune(rows: DataFrame, class_col: str = "class") -> bool:
    return _both(rows, "tune", class_col)


def can_test(rows: DataFrame, class_col: str = "class") -> bool:
    return _both(rows, "test", class_col)


def _both(rows: DataFrame, subset: str, class_col: str) -> bool:
    found = {r[0] for r in rows.where(F.col("subset") == subset).select(class_col).distinct().collect()}
    return {"OK", "NG"} <= found
