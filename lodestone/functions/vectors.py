"""Distances and neighbour averages, as column expressions and as numpy kernels.

The metric names follow the stored models: neighbours are always ranked by the squared distance;
``squared_euclidean`` averages the distances, ``euclidean`` averages the squared ones.

A null vector is no vector: operators leave such rows out before they come here (a query without a vector has no
neighbours, a bank row without one is nobody's neighbour), and the kernels refuse nulls.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def squared_l2(a: Column, b: Column) -> Column:
    """The squared distance of two float arrays, summed from the left in double."""
    terms = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)


def average_of(squared: Column, metric: str) -> Column:
    """The mean over an array of squared distances; 0 for none."""
    term = F.sqrt if metric == "squared_euclidean" else lambda x: x
    total = F.aggregate(squared, F.lit(0.0), lambda s, x: s + term(x))
    return F.when(F.size(squared) > 0, total / F.size(squared)).otherwise(F.lit(0.0))


def squared_matrix(queries: np.ndarray, bank: np.ndarray, most: int = 4_000_000) -> np.ndarray:
    """All squared distances by differences (exact near 0), a slab at a time."""
    queries, bank = queries.astype(np.float64), bank.astype(np.float64)
    out = np.empty((len(queries), len(bank)))
    rows = max(1, most // max(1, bank.size))
    for i in range(0, len(queries), rows):
        d = queries[i : i + rows, None, :] - bank[None, :, :]
        out[i : i + rows] = np.einsum("ijk,ijk->ij", d, d)
    return out


def kd_order(vectors: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """An order in which runs of at most ``size`` vectors lie close together, and where the runs start: the widest side is halved, again and again."""
    order, starts, stack = np.arange(len(vectors)), [], [(0, len(vectors))]
    while stack:
        a, b = stack.pop()
        if b - a <= size:
            starts.append(a)
            continue
        own = vectors[order[a:b]]
        half = (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(own[:, np.argmax(own.max(axis=0) - own.min(axis=0))], half)]
        stack += [(a + half, b), (a, a + half)]
    return order, np.array(starts)


class Rough:
    """Squared distances of two sets of vectors by one matrix product in float32, each off by no more than a slack.

    Both sets are moved by the same ``center``, so that only how far they are spread counts for the slack.
    """

    #: Squared norms beyond which float32 is of no use.
    MOST = 1e30

    def __init__(self, vectors: np.ndarray, center: np.ndarray):
        moved = vectors - center
        self.squares = np.einsum("ij,ij->i", moved, moved)
        self.largest = float(self.squares.max(initial=0.0))
        self.serves = self.largest < self.MOST  # neither for nan
        self.rows = np.empty((len(moved), moved.shape[1] + 2), dtype=np.float32)
        if self.serves:
            self.rows[:, :-2], self.rows[:, -2], self.rows[:, -1] = moved, self.squares, 1

    @property
    def turned(self) -> np.ndarray:
        """The other side of the product."""
        out = np.empty_like(self.rows)
        np.multiply(self.rows[:, :-2], -2, out=out[:, :-2])
        out[:, -2], out[:, -1] = 1, self.squares
        return out.T

    def slack(self, largest: float) -> np.ndarray:
        """What rounding may have done to a row's distances to vectors of squared norms up to ``largest``: over twice the bound of a sum of as many terms."""
        return 4 * (self.rows.shape[1] + 6) * 2.0**-24 * (self.squares + largest) + 1e-30


def over(bound: np.ndarray) -> np.ndarray:
    """In float32, no less."""
    with np.errstate(over="ignore"):
        return np.nextafter(bound.astype(np.float32), np.float32(np.inf))


class Tree:
    """Vectors of few dimensions by boxes, so that a query meets only those that can be near it. The work for a query hardly grows with their number."""

    #: Dimensions at most and vectors at least for which boxes pay; vectors of a box, boxes of a group, queries of a block at most, and vectors for which it is split.
    WIDTH, LEAST, LEAF, GROUP, BLOCK, MANY = 8, 2048, 64, 32, 32, 6000

    def __init__(self, vectors: np.ndarray):
        self.order, starts = kd_order(vectors, self.LEAF)
        self.vectors = vectors[self.order]
        self.norms = np.einsum("ij,ij->i", self.vectors, self.vectors)
        self.starts, self.sizes = starts, np.diff(np.append(starts, len(vectors)))
        self.low, self.high = np.minimum.reduceat(self.vectors, starts), np.maximum.reduceat(self.vectors, starts)
        self.groups = np.arange(0, len(starts), self.GROUP)
        self.group_low, self.group_high = np.minimum.reduceat(self.low, self.groups), np.maximum.reduceat(self.high, self.groups)

    @staticmethod
    def serves(vectors: np.ndarray) -> bool:
        return 0 < vectors.shape[1] <= Tree.WIDTH and len(vectors) >= Tree.LEAST and bool(np.isfinite(vectors).all())

    @staticmethod
    def _apart(low: np.ndarray, high: np.ndarray, own_low: np.ndarray, own_high: np.ndarray) -> np.ndarray:
        """The least squared distances of boxes from one."""
        gap = np.maximum(np.maximum(low - own_high, own_low - high), 0)
        return np.einsum("ij,ij->i", gap, gap)

    def _boxes(self, groups: np.ndarray) -> np.ndarray:
        every = (self.groups[groups][:, None] + np.arange(self.GROUP)).reshape(-1)
        return every[every < len(self.starts)]

    def _places(self, boxes: np.ndarray) -> np.ndarray:
        sizes = self.sizes[boxes]
        return np.repeat(self.starts[boxes] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())

    def _closest(self, point: np.ndarray, k: int) -> np.ndarray:
        """A few boxes near a point: of its nearest group, four or as many as hold k vectors."""
        boxes = self._boxes(np.argmin(self._apart(self.group_low, self.group_high, point, point))[None])
        boxes = boxes[np.argsort(self._apart(self.low[boxes], self.high[boxes], point, point), kind="stable")]
        return boxes[: max(4, int(np.searchsorted(np.cumsum(self.sizes[boxes]), k)) + 1)]

    def _reached(self, low: np.ndarray, high: np.ndarray, within: float) -> np.ndarray:
        """Places of the vectors in boxes within a squared distance of a box."""
        boxes = self._boxes(np.flatnonzero(self._apart(self.group_low, self.group_high, low, high) <= within))
        return self._places(boxes[self._apart(self.low[boxes], self.high[boxes], low, high) <= within])

    def _rough(self, own: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances by norms and a product, and what rounding may have done to a query's."""
        squares, norms = np.einsum("ij,ij->i", own, own), self.norms[places]
        rough = own @ (self.vectors[places].T * -2)
        rough += squares[:, None]
        rough += norms
        return rough, 1e-12 * (own.shape[1] + 4) * (squares + norms.max(initial=0.0))

    def pairs(self, queries: np.ndarray, k: int, bound: np.ndarray | None = None):
        """By blocks of queries: the queries, and for pairs of one of them (by its place in the block) and a vector (by its number) that may be
        among its k nearest, and within ``bound`` if that is given, the squared distances. A pair that is left out is none of these."""
        order, starts = kd_order(queries, self.BLOCK)
        blocks = [order[a:b] for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(queries)], strict=True)][::-1]
        while blocks:
            at = blocks.pop()
            own = queries[at]
            low, high = own.min(axis=0), own.max(axis=0)
            limit = np.full(len(at), np.inf) if bound is None else bound[at] * (1 + 1e-9)
            if bound is None or not np.isfinite(limit).all():
                places = self._places(self._closest((low + high) / 2, k))
                if len(places) >= k:
                    rough, slack = self._rough(own, places)
                    limit = np.minimum(limit, np.partition(rough, k - 1, axis=1)[:, k - 1] + slack)
            places = self._reached(low, high, max(float(limit.max()), 0.0) * (1 + 1e-9))
            if len(places) > self.MANY and len(at) > 4:  # queries that lie far apart are held against fewer vectors in halves
                half = len(at) // 2
                halves = np.argpartition(own[:, np.argmax(high - low)], half)
                blocks += [at[halves[half:]], at[halves[:half]]]
                continue
            step = max(1, 4_000_000 // max(1, len(places)))
            for i in range(0, len(at), step):
                rough, slack = self._rough(own[i : i + step], places)
                row, column = np.nonzero(rough <= (limit[i : i + step] + slack)[:, None])
                d = own[i : i + step][row] - self.vectors[places[column]]
                yield at[i : i + step], row, self.order[places[column]], np.einsum("ij,ij->i", d, d)

    def lower(self, near: np.ndarray, queries: np.ndarray) -> int:
        """Lowers ``near`` to the squared distances from the queries to the nearest vector; returns the pairs whose distance was taken."""
        taken = 0
        for at, row, _, d2 in self.pairs(queries, 1, near):
            now = near[at]
            np.minimum.at(now, row, d2)
            near[at] = now
            taken += len(row)
        return taken


class Bank:
    """Vectors (their ids ascending) that queries are held against. Many vectors of few dimensions are held by boxes."""

    #: Distances of a slab; of a product in float32, and the vectors of one.
    MOST, SLAB, PART = 4_000_000, 1 << 20, 4096

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        self.vectors, self.ids = np.ascontiguousarray(vectors, dtype=np.float64), ids
        self.tree = Tree(self.vectors) if Tree.serves(self.vectors) else None

    @cached_property
    def norms(self) -> np.ndarray:
        return np.einsum("ij,ij->i", self.vectors, self.vectors)

    @cached_property
    def largest(self) -> float:
        return float(self.norms.max(initial=0.0))

    def nearest(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Each query's k nearest (fewer in a small bank): squared distances and ids, nearest first, at equal distance the lower id.

        Norms and one matrix product leave the vectors that may be among the k nearest, whatever rounding did; their
        distances are then taken by differences, which are exact near 0.
        """
        queries = np.ascontiguousarray(queries, dtype=np.float64)
        n, k = len(queries), min(k, len(self.ids))
        near, ids = np.empty((n, k)), np.empty((n, k), dtype=np.int64)
        if self.tree is not None and 0 < k <= Tree.LEAF and n and np.isfinite(queries).all():
            for at, row, number, d2 in self.tree.pairs(queries, k):
                order = np.lexsort((number, d2, row))
                first = np.searchsorted(row, np.arange(len(at)))
                take = order[(first[:, None] + np.arange(k)).reshape(-1)]
                near[at], ids[at] = d2[take].reshape(-1, k), self.ids[number[take]].reshape(-1, k)
            return near, ids
        step = max(1, self.MOST // max(1, len(self.ids)))
        for at in range(0, n if k else 0, step):
            own = queries[at : at + step]
            norms = np.einsum("ij,ij->i", own, own)
            rough = own @ self.vectors.T
            rough *= -2
            rough += norms[:, None]
            rough += self.norms
            bound = np.partition(rough, k - 1, axis=1)[:, k - 1] + 1e-12 * (own.shape[1] + 4) * (norms + self.largest)
            row, column = np.nonzero(rough <= bound[:, None])
            d = own[row] - self.vectors[column]
            d2 = np.einsum("ij,ij->i", d, d)
            order = np.lexsort((column, d2, row))
            first = np.searchsorted(row, np.arange(len(own)))  # rows ascend, so an order within rows keeps their places
            take = order[(first[:, None] + np.arange(k)).reshape(-1)]
            near[at : at + step], ids[at : at + step] = d2[take].reshape(-1, k), self.ids[column[take]].reshape(-1, k)
        return near, ids

    def within(self, queries: np.ndarray, k: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of a query (by its place) and a vector: squared distances and ids. All that are among a query's k nearest and within its ``bound`` are there."""
        queries = np.ascontiguousarray(queries, dtype=np.float64)
        if self.tree is not None and 0 < k <= Tree.LEAF and len(queries) and np.isfinite(queries).all():
            found = [(np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0, dtype=np.int64))]
            for at, row, number, d2 in self.tree.pairs(queries, k, bound):
                order = np.lexsort((number, d2, row))
                order = order[(np.arange(len(row)) - np.searchsorted(row, row) < k) & (d2[order] <= bound[at[row]])]
                found.append((at[row[order]], d2[order], self.ids[number[order]]))
            return tuple(np.concatenate(x) for x in zip(*found, strict=True))
        d2, ids = self.nearest(queries, k)
        row, place = np.nonzero(~(d2 > bound[:, None]))
        return row, d2[row, place], ids[row, place]

    @cached_property
    def turned(self) -> tuple[np.ndarray, Rough, np.ndarray] | None:
        """The center, the estimates' side of the vectors, and that side of their product; None where float32 is of no use."""
        with np.errstate(invalid="ignore", over="ignore"):
            center = self.vectors.mean(axis=0)
            rough = Rough(self.vectors, center)
        return (center, rough, rough.turned) if rough.serves else None

    def passing(self, queries: np.ndarray, k: int, bound: Callable[[], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The pairs of ``within``, of a part of the vectors after the other; ``bound`` is asked before each, so that what was found before counts.

        Of many dimensions, products in float32 leave the pairs whose distances are taken exactly.
        """
        queries = np.ascontiguousarray(queries, dtype=np.float64)
        own = None
        if self.tree is None and k and len(self.ids) and len(queries) and self.turned:
            with np.errstate(invalid="ignore", over="ignore"):
                own = Rough(queries, self.turned[0])
        if own is None or not own.serves:
            if len(self.ids):
                yield self.within(queries, k, bound())
            return
        _, other, turned = self.turned
        slack = own.slack(other.largest)
        for first in range(0, len(self.ids), self.PART):
            now, columns = bound(), turned[:, first : first + self.PART]
            n = columns.shape[1]
            step = max(1, self.SLAB // n)
            found = []
            for at in range(0, len(queries), step):
                here = slice(at, at + step)
                rough = own.rows[here] @ columns
                limit = now[here].copy()
                open_ = np.flatnonzero(np.isinf(limit))
                if len(open_) and n > k:
                    limit[open_] = np.partition(rough[open_], k - 1, axis=1)[:, k - 1].astype(np.float64) + slack[here][open_]
                row, column = np.divmod(np.flatnonzero(rough <= over(limit + slack[here])[:, None]), n)
                row, column = row + at, column + first
                d2 = np.empty(len(row))
                for i in range(0, len(row), 65_536):
                    d = queries[row[i : i + 65_536]] - self.vectors[column[i : i + 65_536]]
                    d2[i : i + 65_536] = np.einsum("ij,ij->i", d, d)
                kept = d2 <= now[row]
                found.append((row[kept], d2[kept], self.ids[column[kept]]))
            yield tuple(np.concatenate(x) for x in zip(*found, strict=True))


def top_k(squared: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's k smallest and their ids, nearest first, at equal distance the lower id. ``ids`` ascend."""
    k = min(k, squared.shape[1])
    if k == 0:
        return np.empty((len(squared), 0)), np.empty((len(squared), 0), dtype=np.int64)
    if squared.shape[1] > 4 * k:
        bound = np.partition(squared, k - 1, axis=1)[:, k - 1 : k]
        columns = np.flatnonzero((squared <= bound).any(axis=0))
        squared, ids = squared[:, columns], ids[columns]
    order = np.argsort(squared, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(squared, order, axis=1), ids[order]


def matrix(column, width: int | None = None) -> np.ndarray:
    """An Arrow list column of equal lengths, without nulls, as a matrix."""
    if column.null_count:
        raise ValueError("null vectors have no distances")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    n = len(column)
    if n and len(flat) % n:
        raise ValueError("vectors of one table must have one length")
    return flat.reshape(n, -1) if n else flat.reshape(0, width or 0)
