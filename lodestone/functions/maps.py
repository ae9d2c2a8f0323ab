"""Maps and images as array columns: resizing, smoothing, colouring, blending and preprocessing as column expressions.

A map is an array of rows, one after the other; an image is one of interleaved blue, green and red values. Heights and widths are those of the plan, so
taps and weights are small constant tables, and every expression stays in the JVM: no shuffle, no Python worker. A null map gives null.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.images import MEAN, STD, coloured, kernel_side


def bilinear(n_out: int, n_in: int) -> list[list[tuple[int, float]]]:
    """For each place of the result its (place, weight) in the source, with half-pixel centres."""
    out = []
    for i in range(n_out):
        at = (i + 0.5) * n_in / n_out - 0.5
        low = int(np.floor(at))
        part = 0.0 if low < 0 else at - low
        first, second = min(max(low, 0), n_in - 1), min(max(low + 1, 0), n_in - 1)
        out.append([(first, 1.0 - part), (second, part)])
    return out


def gaussian(n: int, side: int, sigma: float) -> list[list[tuple[int, float]]]:
    """For each place its (place, weight) under a Gaussian of ``side`` taps; an edge mirrors what is inside it, and is not repeated itself unless the kernel is longer than the map."""
    half = side // 2
    at = np.arange(side) - half
    kernel = np.exp(-(at**2) / (2 * sigma**2))
    kernel /= kernel.sum()
    places = np.pad(np.arange(n), half, mode="reflect" if n > half else "symmetric")
    return [[(int(places[i + k]), float(kernel[k])) for k in range(side)] for i in range(n)]


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, though the body names it for each of its elements."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _table(values, kind: str) -> Column:
    return F.array(*(F.lit(v) for v in values)).cast(f"array<{kind}>")


def along(values: Column, before: int, taps: list[list[tuple[int, float]]], n_in: int, after: int) -> Column:
    """Weighted sums along one axis of an array of shape (before, n_in, after): the axis gets a place for each of ``taps``."""
    n, most = len(taps), max(map(len, taps))
    places = _table([p for row in taps for p, _ in [*row, *[(0, 0.0)] * (most - len(row))]], "int")
    weights = _table([w for row in taps for _, w in [*row, *[(0, 0.0)] * (most - len(row))]], "double")

    def every(source: Column) -> Column:
        def one(i: Column) -> Column:
            axis, rest = F.floor(i / after) % n, i % after
            block = F.floor(i / (after * n)) * (n_in * after)
            total = F.lit(0.0)
            for k in range(most):
                tap = (axis * most + k).cast("int")
                total = total + F.get(weights, tap) * F.get(source, (block + F.get(places, tap) * after + rest).cast("int"))
            return total

        return F.when(source.isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(before * n * after - 1)), one))

    return bound(values, every)


def resized(values: Column, shape: tuple[int, int], to: tuple[int, int], channels: int = 1) -> Column:
    """Bilinear with half-pixel centres; ``channels`` values stand for each point."""
    (h, w), (hh, ww) = shape, to
    wide = along(values, h, bilinear(ww, w), w, channels)
    return along(wide, 1, bilinear(hh, h), h, ww * channels)


def smoothed(values: Column, shape: tuple[int, int], sigma: float = 4.0) -> Column:
    """Separable Gaussian smoothing; the kernel's side follows the map's shorter side."""
    h, w = shape
    side = kernel_side(h, w, sigma)
    return along(along(values, h, gaussian(w, side, sigma), w, 1), 1, gaussian(h, side, sigma), h, w)


def levels(scores: Column) -> Column:
    """Scores from 0 to 255 over their map's range; null if they hardly differ."""

    def spread(ends: Column) -> Column:
        own, low, span = ends["scores"], ends["low"], ends["high"] - ends["low"]
        return F.when(span > 1e-8, F.transform(own, lambda x: F.rint((x - low) * 255 / span).cast("int")))

    return bound(bound(scores, lambda s: F.struct(s.alias("scores"), F.array_min(s).alias("low"), F.array_max(s).alias("high"))), spread)


def colours(level: Column) -> Column:
    """Interleaved blue, green and red of each level on the blue to red rainbow."""
    table = _table(coloured(np.arange(256)).reshape(-1).tolist(), "int")
    return F.flatten(F.transform(level, lambda x: F.slice(table, x * 3 + 1, 3)))


def blended(image: Column, over: Column, weight: float = 0.4) -> Column:
    """The image with ``over`` laid on it by ``weight``; the image itself where that is null."""
    return F.coalesce(F.zip_with(image, over, lambda a, b: F.rint((1 - weight) * a + weight * b).cast("int")), image.cast("array<int>"))


def overlay(image: Column, scores: Column, shape: tuple[int, int], to: tuple[int, int]) -> Column:
    """An image of shape ``to`` with its score map smoothed, resized, spread over its range, coloured and blended over it."""
    return blended(image, colours(levels(resized(smoothed(scores, shape), shape, to))))


def preprocessed(image: Column, shape: tuple[int, int], size: int, mode: str = "standard") -> Column:
    """An interleaved blue, green, red image as three planes of size x size in the order red, green, blue; the modes are those of ``images.preprocessed``."""
    if mode not in ("fused", "standard", "normalised"):
        raise ValueError(f"there is no preprocessing mode {mode}")
    mean, std = (_table(x.tolist(), "double") for x in (MEAN, STD))
    n = size * size

    def every(points: Column) -> Column:
        def one(i: Column) -> Column:
            channel = F.floor(i / n).cast("int")
            value = F.rint(F.get(points, ((i % n) * 3 + 2 - channel).cast("int")))
            if mode == "fused":
                return value
            return (value - F.get(mean, channel)) / 255 / F.get(std, channel) if mode == "standard" else (value / 255 - F.get(mean, channel)) / F.get(std, channel)

        return F.when(points.isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(3 * n - 1)), one))

    return bound(resized(image, shape, (size, size), 3), every)
