"""Steps of a run: what began, how long it took, and its share of the whole.

Spark runs a plan's steps together, so a step is what the caller materialises in it. What the stages inside one job took is summed by the workers: ``StageTimes``.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def elapsed(ms: float) -> str:
    """A duration as ``scalars.elapsed`` writes it."""
    for size, unit in ((3_600_000, "h"), (60_000, "m"), (1000, "s")):
        if ms >= size:
            return f"{ms / size:.1f}{unit}"
    return f"{ms:.0f}ms"


class StageTimes:
    """Seconds that the stages of a prediction took on all workers together, within whatever jobs run them.

    A worker's kernel times a stage as ``with times("knn"):``; the sums come back with the tasks' results. Work of a task that is tried again counts again.
    """

    STAGES = ("preprocess", "extract", "downscale", "aggregate", "knn", "judge", "heatmap")

    def __init__(self, spark: SparkSession):
        self._sums = {s: spark.sparkContext.accumulator(0.0) for s in self.STAGES}

    @contextmanager
    def __call__(self, stage: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self._sums[stage].add(time.perf_counter() - began)

    def seconds(self) -> dict[str, float]:
        """So far, on the driver."""
        return {s: a.value for s, a in self._sums.items()}


@contextmanager
def untimed(stage: str) -> Iterator[None]:
    """Stands for ``StageTimes`` where nobody asks."""
    yield


class Progress:
    """Times steps and reports them; ``report`` gets one line for each."""

    def __init__(self, report: Callable[[str], None] | None = None):
        self.report = report or (lambda line: None)
        self.stages: dict[str, float] = {}

    def info(self, line: str) -> None:
        self.report(line)

    @contextmanager
    def step(self, name: str) -> Iterator[None]:
        self.report(f"{name} ...")
        began = time.perf_counter()
        try:
            yield
        finally:
            self.stages[name] = self.stages.get(name, 0.0) + 1000 * (time.perf_counter() - began)
            self.report(f"{name} {elapsed(self.stages[name])}")

    def counter(self, name: str) -> Callable[[int, int], None]:
        """What to tell a step's progress to, as (done, all): a line has the share, the time so far, and the time left at this rate."""
        began = time.perf_counter()

        def told(done: int, every: int) -> None:
            ms = 1000 * (time.perf_counter() - began)
            left = elapsed(ms / done * (every - done)) if done else "?"
            self.report(f"{name} {done}/{every} ({100 * done / max(1, every):.0f}%) | {elapsed(ms)} | {left} left")

        return told

    @property
    def total(self) -> float:
        return sum(self.stages.values())

    def summary(self) -> list[str]:
        """The stages with their times and the sum, and their shares (empty if no time passed)."""
        times = [f"{name} {elapsed(ms)}" for name, ms in self.stages.items()] + [f"total {elapsed(self.total)}"]
        shares = [f"{name} {ms / self.total * 100:.1f}%" for name, ms in self.stages.items()] if self.total > 0 else []
        return [" | ".join(times), " | ".join(shares)]
