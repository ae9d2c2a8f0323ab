"""Order statistics and running sums without a global window.

Rows are range-partitioned by the key, each partition is summed by itself, and one row per partition gives the offsets
and the next partition's first key.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import groupby

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.shared import checkpointed

#: Rows that are sorted on the driver to end a search.
FEW = 10_000


def running(df: DataFrame, key: str, sums: list[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows of distinct ``key`` with ``cum_<s>`` for each sum (this row included) and ``next_key``, the next greater key or null.

    With ``by`` (columns without nulls, of few values) each group is summed by itself, all in the same jobs.
    """
    spark = df.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = checkpointed(df.repartitionByRange(n, *by, key).withColumn("part", F.spark_partition_id()))
    parts = dealt.groupBy(*by, "part").agg(F.min(key).alias("low"), *(F.sum(s).alias(s) for s in sums)).orderBy(*by, "part").collect()  # one row per partition and group
    before = []
    for _, group in groupby(parts, lambda r: tuple(r[c] for c in by)):
        own, total = list(group), dict.fromkeys(sums, 0)
        for r, after in zip(own, [*own[1:], None], strict=True):
            before.append((*(r[c] for c in by), r["part"], *(int(total[s]) for s in sums), after and after["low"]))
            total = {s: total[s] + r[s] for s in sums}
    kind = lambda c: f"{c} {df.schema[c].dataType.simpleString()}, "
    offsets = spark.createDataFrame(before, "".join(map(kind, by)) + "part int, " + "".join(f"before_{s} long, " for s in sums) + f"after {df.schema[key].dataType.simpleString()}")
    inside = Window.partitionBy(*by, "part").orderBy(key)
    up_to = inside.rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.join(F.broadcast(offsets), [*by, "part"])
    for s in sums:
        out = out.withColumn(f"cum_{s}", F.col(f"before_{s}") + F.sum(s).over(up_to))
    out = out.withColumn("next_key", F.coalesce(F.lead(key).over(inside), F.col("after")))
    return out.drop("part", "after", *(f"before_{s}" for s in sums))


def at_rank(df: DataFrame, column: str, rank: int) -> float | None:
    """The value of the given rank (from 0) in ascending order, by narrowing a range of values until few rows are left in it."""
    rows = df.select(F.col(column).alias("v")).where(F.col("v").isNotNull())
    low = high = None
    while True:
        inside = rows if low is None else rows.where((F.col("v") >= low) & (F.col("v") <= high))
        below = 0 if low is None else rows.where(F.col("v") < low).count()
        stats = inside.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).first()
        if not stats["n"] or rank - below >= stats["n"] or rank < below:
            return None
        if stats["a"] == stats["b"]:
            return stats["a"]
        if stats["n"] <= FEW:
            return sorted(r[0] for r in inside.collect())[rank - below]
        cuts = sorted({stats["a"], *inside.agg(F.percentile_approx("v", [k / 64 for k in range(1, 64)], 10_000)).first()[0], stats["b"]})
        counts = inside.agg(*(F.count(F.when(F.col("v") <= c, 1)).alias(f"c{k}") for k, c in enumerate(cuts))).first()
        k = next(k for k in range(len(cuts)) if below + counts[k] > rank)
        new_low, new_high = cuts[k - 1] if k else stats["a"], cuts[k]
        if k and below + counts[k - 1] <= rank and (low, high) == (new_low, new_high):
            return cuts[k] if inside.where((F.col("v") > new_low) & (F.col("v") < new_high)).isEmpty() else at_rank(inside.where(F.col("v") > new_low).withColumnRenamed("v", column), column, rank - below - counts[k - 1])
        low, high = new_low, new_high


def p95_rank(n: int) -> int:
    """Nearest rank from 0 of the 95th percentile, rounded half to even."""
    return max(0, min(n - 1, round(n * 0.95) - 1))


def p95(df: DataFrame, column: str) -> float | None:
    """The 95th percentile by nearest rank; null without rows."""
    n = df.where(F.col(column).isNotNull()).count()
    return at_rank(df, column, p95_rank(n)) if n else None
