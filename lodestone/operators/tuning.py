"""Thresholds, metrics and searches over labelled scores (``score``, ``class`` OK or NG)."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.ordered import running

#: Searched when nothing else is given. Fixed values.
NEIGHBOR_CANDIDATES = (1, 3, 5, 9, 15)
PROBE_PRESETS = (1, 2, 4, 6, 8, 12, 16, 24, 32)
MARGIN = 1e-4
TOLERANCE = 1e-6

METRIC_COLUMNS = ["accuracy", "precision", "recall", "f1"]


def is_anomaly(score: Column, threshold: Column | float) -> Column:
    return score > threshold


def label(score: Column, threshold: Column | float) -> Column:
    return F.when(is_anomaly(score, threshold), "NG").otherwise("OK")


def rates(tp: Column, tn: Column, fp: Column, fn: Column) -> list[Column]:
    """accuracy, precision, recall and f1; 0 where a denominator is 0."""
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return [share(tp + tn, tp + tn + fp + fn).alias("accuracy"), share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1")]


def confusion(scores: DataFrame, threshold: float, by: list[str] = ()) -> DataFrame:
    """tp, tn, fp, fn and the rates at a threshold: an NG row over it is a true positive."""
    over, ng = is_anomaly(F.col("score"), F.lit(threshold)), F.col("class") == "NG"
    count = lambda c: F.count(F.when(c, 1)).cast("long")
    rows = scores.groupBy(*by) if by else scores.groupBy()
    counted = rows.agg(count(ng & over).alias("tp"), count(~ng & ~over).alias("tn"), count(~ng & over).alias("fp"), count(ng & ~over).alias("fn"))
    return counted.select(*by, F.lit(float(threshold)).alias("threshold"), "tp", "tn", "fp", "fn", *rates(*(F.col(c) for c in ("tp", "tn", "fp", "fn"))))


def threshold_candidates(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Every candidate threshold with its counts: midpoints of neighbouring distinct scores in ascending order, then just below the least and just over the greatest score.

    A single distinct score v also has the midpoint of v and v + MARGIN. ``kind`` and ``threshold`` are the order of preference.
    With ``by`` each group of scores has its own candidates.
    """
    ng, ok = F.count(F.when(F.col("class") == "NG", 1)).alias("ng"), F.count(F.when(F.col("class") == "OK", 1)).alias("ok")
    distinct = scores.where(F.col("score").isNotNull()).groupBy(*by, F.col("score").cast("double").alias("score")).agg(ng, ok)
    rows = running(distinct, "score", ["ng", "ok"], by)  # from a checkpoint: the scores are computed once
    ends = rows.groupBy(*by).agg(F.min("score").alias("low"), F.max("score").alias("high"), F.sum("ng").alias("ng_all"), F.sum("ok").alias("ok_all"))
    middle = rows.join(F.broadcast(ends), list(by) or None).select(
        *by,
        F.lit(0).alias("kind"),
        F.when(F.col("next_key").isNotNull(), (F.col("score") + F.col("next_key")) / 2).when(F.col("low") == F.col("high"), (F.col("score") + (F.col("score") + MARGIN)) / 2).alias("threshold"),
        (F.col("ng_all") - F.col("cum_ng")).alias("tp"), F.col("cum_ok").alias("tn"), (F.col("ok_all") - F.col("cum_ok")).alias("fp"), F.col("cum_ng").alias("fn"),
    ).where("threshold is not null")
    zero = F.lit(0).cast("long")
    least = ends.select(*by, F.lit(1).alias("kind"), (F.col("low") - MARGIN).alias("threshold"), F.col("ng_all").alias("tp"), zero.alias("tn"), F.col("ok_all").alias("fp"), zero.alias("fn"))
    most = ends.select(*by, F.lit(2).alias("kind"), (F.col("high") + MARGIN).alias("threshold"), zero.alias("tp"), F.col("ok_all").alias("tn"), zero.alias("fp"), F.col("ng_all").alias("fn"))
    every = middle.unionByName(least).unionByName(most).where("threshold is not null")
    return every.select(*by, "kind", "threshold", "tp", "tn", "fp", "fn", *rates(*(F.col(c) for c in ("tp", "tn", "fp", "fn"))))


def best_threshold(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The candidate of the greatest f1, the first in order of preference: one row for each group of ``by`` (none if a class is missing)."""
    found = threshold_candidates(scores, by).where((F.col("tp") + F.col("fn") > 0) & (F.col("tn") + F.col("fp") > 0))
    columns = [c for c in found.columns if c not in ("kind", *by)]
    best = F.min_by(F.struct(*columns), F.struct(-F.col("f1"), "kind", "threshold")).alias("best")
    return found.groupBy(*by).agg(best).where("best is not null").select(*by, "best.*")


def candidates_of(name: str, given: Iterable[int]) -> list[int]:
    """The candidates of a search, distinct and ascending."""
    found = sorted(set(given))
    if not found:
        raise ValueError(f"there are no candidates for {name}")
    return found


def each(name: str, candidates: Iterable[int], scored: Callable[[int], DataFrame]) -> DataFrame:
    """The scores of every candidate, one below the other, with the candidate as ``name``. Where making them takes jobs, these run beside each other."""
    with ThreadPoolExecutor(max_workers=4) as pool:
        rows = list(pool.map(lambda c: scored(c).withColumn(name, F.lit(c)), candidates_of(name, candidates)))
    return reduce(DataFrame.unionByName, rows)


def best_neighbors(rows: list) -> dict:
    """Of a neighbour sweep: strictly better f1 wins, so the smallest k of equals."""
    best = None
    for r in sorted(rows, key=lambda r: r["num_neighbors"]):
        if best is None or r["f1"] > best["f1"]:
            best = r
    return best


def best_probes(rows: list) -> dict:
    """Of a probe sweep: f1 better by over TOLERANCE wins; within it, fewer probes."""
    best = None
    for r in sorted(rows, key=lambda r: r["ann_probes"]):
        if best is None or r["f1"] > best["f1"] + TOLERANCE or (abs(r["f1"] - best["f1"]) <= TOLERANCE and r["ann_probes"] < best["ann_probes"]):
            best = r
    return best


def probe_candidates(clusters: int, given: Iterable[int] | None = None) -> list[int]:
    """The presets (or given values) and the cluster count, distinct, within 1 and the cluster count."""
    return sorted({p for p in [*(PROBE_PRESETS if given is None else given), clusters] if 1 <= p <= clusters})
