"""Greedy farthest-first coreset.

The first member is the row with the least seeded order; each next one is the row farthest from all
members, the lowest id at equal distance. The result keeps the order of selection.

Each pick depends on the one before. A bank within ONE_TASK_BYTES is sampled by one task in numpy. A larger one is sampled in passes,
by bounds that leave out what no pick can depend on, and with the very members of the greedy method:

- Rows are dealt once into pieces: those nearest to the same pivot, cut into slices of bounded size. Their vectors are written once, bucketed by
  piece, and never again.
- What a row is from its nearest member only falls. So a piece's greatest such distance, from whenever it was last taken, bounds all its rows: while it
  is below the distances at which members are being picked, the piece isn't read.
- A member reaches a piece only if it is closer to the piece's pivot than the piece's radius and that bound together (the triangle inequality); all
  others are left out for the piece.
- A pass takes the pieces of the greatest bounds up to date in one join without a shuffle of vectors, and writes their rows' ids and distances only. The rows
  farthest from the members, CANDIDATES at most, meet in one task, and members are picked among them for as long as none outside can be
  farther than the farthest candidate. Only the members themselves come to the driver. Among candidates a block of the farthest gives members for as long as
  its farthest is over all others; these are lowered by all members of a block at once. Of few dimensions, candidates are held in boxes, and a member
  lowers those that it reaches.
- In a task, a matrix product (in float32, with a bound of its error) leaves the pairs that may be a row's nearest, whose distances are then taken
  exactly. Where vectors have few dimensions, only members in boxes near a row are looked at.

Rows without a vector are no members.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.vectors import Bank, Rough, Tree, matrix, over
from lodestone.operators import ordered
from lodestone.operators.knn import bank_bytes, collected, with_vector
from lodestone.operators.split import seeded
from lodestone.shared import checkpointed, removed, shared_folder, ship

ONE_TASK_BYTES = 16 << 20
#: Rows that meet in a pass's task, and the bytes of their vectors. They are all rows over one of LEVELS squared distances, each STEP of the one before.
CANDIDATES, CANDIDATE_BYTES = 262_144, 64 << 20
LEVELS, STEP = 1024, 0.9975
#: The farthest candidates among which members are picked before all others are lowered.
BLOCK = 1024
#: The share of the greatest distance down to which a pass takes pieces up to date; for few dimensions, where that is cheap, a smaller one.
SHARE, NARROW_SHARE = 0.9, 0.5
#: Members that the driver holds before it hands them over.
PART = 5000
#: Members that a piece may lag behind, and the bytes of their vectors: they are sent to the workers.
LAG, LAG_BYTES = 262_144, 32 << 20
#: Pivots at most, rows for each, and rows of a piece.
PIVOTS, ROWS_A_PIVOT, PIECE_ROWS = 256, 1000, 50_000


def target(n: int, ratio: float) -> int:
    """Half-even rounding, and at least one; all rows if that is no fewer than n."""
    return min(n, max(1, round(n * ratio)))


def squared_from(vectors: np.ndarray, center: np.ndarray) -> np.ndarray:
    return ((vectors - center) ** 2).sum(axis=1)


def farthest_first(vectors: np.ndarray, first: int, m: int) -> list[int]:
    """Places of the members in order of selection."""
    vectors = vectors.astype(np.float64)
    chosen = [first]
    nearest = squared_from(vectors, vectors[first])
    if len(vectors) > BLOCK and np.isfinite(vectors).all():
        chosen += (_picked_by_boxes if Tree.serves(vectors) else _picked_by_blocks)(vectors, nearest, 0.0, False, m - 1)[0]
        return chosen + [0] * (m - len(chosen))  # at distance 0 the lowest place comes again and again
    while len(chosen) < m:
        at = int(np.argmax(nearest))
        chosen.append(at)
        np.minimum(nearest, squared_from(vectors, vectors[at]), out=nearest)
    return chosen


def picked(ids: np.ndarray, vectors: np.ndarray, near: np.ndarray, bound: float, first: bool, most: int) -> tuple[list[int], int]:
    """Places of members among candidates (``ids`` ascending, ``near`` their squared distances), as the greedy method picks them while the farthest is over ``bound``
    (the first also at it, if ``first``); and the pairs whose distance was taken."""
    vectors = np.ascontiguousarray(vectors, dtype=np.float64)
    way = _picked_by_heap if len(ids) <= BLOCK or not np.isfinite(vectors).all() else _picked_by_boxes if Tree.serves(vectors) else _picked_by_blocks
    return way(vectors, near, bound, first, min(most, len(ids)))


def _picked_by_heap(vectors: np.ndarray, near: np.ndarray, bound: float, first: bool, most: int) -> tuple[list[int], int]:
    heap = [(-d, k, 0) for k, d in enumerate(near.tolist())]  # ids ascend, so the lowest of equals is first
    heapq.heapify(heap)
    chosen: list[int] = []
    held, pairs = np.empty((most, vectors.shape[1])), 0
    while len(chosen) < most:
        far, k, upto = heap[0]
        if upto < len(chosen):  # an old distance is a bound: bring it up to date and look again
            heapq.heapreplace(heap, (max(far, -float(squared_from(held[upto : len(chosen)], vectors[k]).min())), k, len(chosen)))
            pairs += len(chosen) - upto
            continue
        if -far <= bound and (chosen or not first or -far < bound):
            break
        held[len(chosen)] = vectors[k]
        chosen.append(k)
        heapq.heapreplace(heap, (0.0, k, len(chosen)))
    return chosen, pairs


def _picked_by_blocks(vectors: np.ndarray, near: np.ndarray, bound: float, first: bool, most: int) -> tuple[list[int], int]:
    place, now = np.arange(len(vectors)), near.astype(np.float64)
    rows, chosen, pairs = Lowered(vectors), [], 0
    while len(chosen) < most:
        live = now > bound
        if not chosen and first:
            live |= now == bound
        if 4 * np.count_nonzero(live) < 3 * len(now):  # what is within the bound is no member of this call
            place, now = place[live], now[live]
            rows = Lowered(rows.own[live])
            continue
        if not live.any():
            break
        # a block of the farthest, and the greatest distance beside it
        rest = -np.inf if len(now) <= BLOCK else float(np.partition(now, len(now) - BLOCK - 1)[len(now) - BLOCK - 1])
        at = np.flatnonzero(now > rest)
        ties = not len(at)
        if ties:  # more than a block at the greatest distance: those of the lowest places
            at = np.flatnonzero(now == rest)[:BLOCK]
        own, far = rows.own[at], now[at]
        norms = np.einsum("ij,ij->i", own, own)
        rough = own @ own.T * -2 + norms[:, None] + norms
        slack = 1e-12 * (own.shape[1] + 4) * (norms + norms.max())  # over any error of the product
        new: list[int] = []
        while len(chosen) < most:
            k = int(np.argmax(far))  # places ascend, so the lowest of equals
            top = far[k]
            if top < rest or top == rest and not ties or top <= bound and (chosen or not first or top < bound):
                break
            lowered = np.flatnonzero(rough[k] <= far + slack)
            far[lowered] = np.minimum(far[lowered], squared_from(own[lowered], own[k]))
            far[k] = 0.0
            chosen.append(int(place[at[k]]))
            new.append(k)
            pairs += len(lowered)
        if not new:
            break
        pairs += rows.lower(now, own[new])
        now[at[new]] = 0.0
    return chosen, pairs


def _picked_by_boxes(vectors: np.ndarray, near: np.ndarray, bound: float, first: bool, most: int) -> tuple[list[int], int]:
    tree = Tree(vectors)
    box = np.repeat(np.arange(len(tree.starts)), tree.sizes)
    order = np.lexsort((tree.order, box))  # in a box the lowest id is first
    place, starts, sizes = tree.order[order], tree.starts, tree.sizes
    rows, now = vectors[place], near[place].astype(np.float64)
    high = np.maximum.reduceat(now, starts)
    chosen: list[int] = []
    pairs = 0
    while len(chosen) < most:
        far = high.max()
        if far <= bound and (chosen or not first or far < bound):
            break
        at = min((int(starts[b] + np.argmax(now[starts[b] : starts[b] + sizes[b]])) for b in np.flatnonzero(high == far)), key=lambda i: place[i])
        chosen.append(int(place[at]))
        member = rows[at]
        reached = np.flatnonzero(tree._apart(tree.low, tree.high, member, member) * (1 - 1e-9) < high)
        if len(reached):
            n = sizes[reached]
            ends = np.cumsum(n)
            inside = np.repeat(starts[reached] - ends + n, n) + np.arange(ends[-1])
            lowered = np.minimum(now[inside], squared_from(rows[inside], member))
            now[inside] = lowered
            high[reached] = np.maximum.reduceat(lowered, ends - n)
            pairs += len(inside)
    return chosen, pairs


@dataclass
class Work:
    """What sampling in passes did: passes, rows taken up to date, and pairs of a row and a member whose distance was taken exactly."""

    passes: int = 0
    rows: int = 0
    pairs: int = 0
    members: int = 0


def sample(
    bank: DataFrame, ratio: float, seed: int = 0, id_col: str = "bank_id", vector: str = "emb", limit: int = ONE_TASK_BYTES, report: Callable[[int, int], None] | None = None, work: Work | None = None
) -> DataFrame:
    """The members: ``pick`` from 0 in order of selection, the id and the vector. All rows, in id order, if the target is no fewer.

    Sampling in passes tells ``report`` after each how many members it has, and of how many, and fills ``work``.
    """
    ship(bank.sparkSession)
    rows = with_vector(bank, vector).select(F.col(id_col).cast("long").alias(id_col), vector)
    n = rows.count()
    m = target(n, ratio)
    kind = bank.schema[vector].dataType.simpleString()
    if n == 0:
        return rows.select(F.lit(0).alias("pick"), id_col, vector)
    first = rows.orderBy(seeded(seed, F.col(id_col)), id_col).select(id_col).first()[0]
    if bank_bytes(rows, vector) <= limit:

        def run(batches):
            table = pa.Table.from_batches(list(batches)).combine_chunks().sort_by(id_col)
            if table.num_rows:
                ids = table.column(0).to_numpy()
                if m >= table.num_rows:
                    picks = list(range(table.num_rows))
                else:
                    picks = farthest_first(matrix(pa.concat_arrays(table.column(1).chunks)), int(np.searchsorted(ids, first)), m)
                out = table.take(pa.array(picks)).add_column(0, "pick", pa.array(np.arange(len(picks), dtype=np.int32)))
                yield from out.combine_chunks().to_batches()

        return rows.repartition(1).mapInArrow(run, f"pick int, {id_col} long, {vector} {kind}")
    if m >= n:
        numbered = ordered.running(rows.withColumn("one", F.lit(1).cast("long")), id_col, ["one"])
        return numbered.select((F.col("cum_one") - 1).cast("int").alias("pick"), id_col, vector)
    return _Passes(rows, n, first, m, id_col, vector).members(report, work or Work())


class Lowered:
    """Rows whose squared distances to the nearest member are lowered by more and more members."""

    #: Distances of a product, and members of one.
    SLAB, MEMBERS = 1 << 20, 2048

    def __init__(self, own: np.ndarray):
        self.own = np.ascontiguousarray(own, dtype=np.float64)
        with np.errstate(invalid="ignore", over="ignore"):
            self.center = self.own.mean(axis=0) if len(own) else np.zeros(own.shape[1])
            self.rough = Rough(self.own, self.center)

    def lower(self, near: np.ndarray, members: np.ndarray) -> int:
        """Returns the pairs whose distance was taken exactly."""
        taken = 0
        for i in range(0, len(members) if len(near) else 0, self.MEMBERS):
            some = members[i : i + self.MEMBERS]
            with np.errstate(invalid="ignore", over="ignore"):
                other = Rough(some, self.center)
            if not (self.rough.serves and other.serves):
                taken += self._lower(near, self.own, some)
                continue
            turned, slack = other.turned, self.rough.slack(other.largest)
            step = max(1, self.SLAB // len(some))
            for at in range(0, len(near), step):
                here = slice(at, at + step)
                rough = self.rough.rows[here] @ turned
                low = rough.min(axis=1).astype(np.float64)
                hit = np.flatnonzero(low <= near[here] + slack[here])
                if not len(hit):
                    continue
                rough = rough if len(hit) == len(rough) else rough[hit]
                hit += at
                limit = over(np.minimum(near[hit], low[hit - at] + slack[hit]) + slack[hit])
                row, column = np.divmod(np.flatnonzero(rough <= limit[:, None]), len(some))
                if len(row) > 16 * len(hit):  # rows lie so close together that float32 can't tell them apart
                    part = near[hit]
                    taken += self._lower(part, self.own[hit], some)
                    near[hit] = part
                else:
                    np.minimum.at(near, hit[row], squared_from(self.own[hit[row]], some[column]))
                    taken += len(row)
        return taken

    @staticmethod
    def _lower(near: np.ndarray, own: np.ndarray, members: np.ndarray, slab: int = 1_000_000) -> int:
        """The same by a product in double."""
        taken = 0
        norms = np.einsum("ij,ij->i", members, members)
        largest = float(norms.max(initial=0.0))
        step = max(1, slab // max(1, len(members)))
        for at in range(0, len(own) if len(members) else 0, step):
            rows, now = own[at : at + step], near[at : at + step]
            squares = np.einsum("ij,ij->i", rows, rows)
            rough = rows @ members.T
            rough *= -2
            rough += squares[:, None]
            rough += norms
            slack = 1e-12 * (own.shape[1] + 4) * (squares + largest)  # over any error of the product
            bound = np.minimum(now, rough.min(axis=1) + slack) + slack
            row, column = np.nonzero(rough <= bound[:, None])
            np.minimum.at(now, row, squared_from(rows[row], members[column]))
            taken += len(row)
        return taken


def relaxed(near: np.ndarray, own: np.ndarray, members: np.ndarray) -> int:
    """Lowers ``near`` to the squared distances from ``own`` rows to the nearest of ``members``; returns the pairs whose distance was taken."""
    if Tree.serves(members) and np.isfinite(own).all():
        return Tree(members).lower(near, own)
    return Lowered(own).lower(near, members)


@dataclass
class _Pieces:
    """The pieces on the driver: for each its pivot, radius and rows, a bound of its rows' squared distances to the members, the members it has been held against, and the table that its distances are in."""

    pivot: np.ndarray
    radius: np.ndarray
    size: np.ndarray
    high: np.ndarray = field(init=False)
    upto: np.ndarray = field(init=False)
    table: np.ndarray = field(init=False)

    def __post_init__(self):
        n = len(self.pivot)
        self.high, self.upto, self.table = np.full(n, np.inf), np.zeros(n, dtype=np.int64), np.full(n, -1)


class _Passes:
    def __init__(self, rows: DataFrame, n: int, first: int, m: int, id_col: str, vector: str):
        self.spark, self.rows, self.n, self.first, self.m, self.id_col, self.vector = rows.sparkSession, rows, n, first, m, id_col, vector
        self.name = f"coreset_{uuid.uuid4().hex}"
        self.folder = f"{shared_folder(self.spark)}/coreset-{self.name[8:]}"
        self.tables: list[str] = []

    def _write(self, rows: DataFrame, what: str) -> DataFrame:
        """A table bucketed by piece, in the shared folder."""
        name = f"{self.name}_{what}"
        rows.repartition(self.buckets, "piece").write.bucketBy(self.buckets, "piece").sortBy("piece").option("path", f"{self.folder}/{what}").saveAsTable(name)
        self.tables.append(name)
        return self.spark.table(name)

    def _drop(self, what: str) -> None:
        name = f"{self.name}_{what}"
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        removed(self.spark, f"{self.folder}/{what}")
        self.tables.remove(name)

    def _deal(self) -> None:
        """Writes the vectors by piece."""
        _, self.pivots = collected(self.rows.orderBy(F.xxhash64(self.id_col), self.id_col).limit(max(1, min(PIVOTS, self.n // ROWS_A_PIVOT))), self.id_col, self.vector)
        width = self.pivots.shape[1]
        shared, names = self.spark.sparkContext.broadcast(self.pivots), [self.id_col, self.vector, "cell", "d2"]  # PIVOTS at most

        def run(batches):
            bank = Bank(shared.value, np.arange(len(shared.value)))
            for batch in batches:
                d2, cell = bank.nearest(matrix(batch.column(1), width), 1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell[:, 0].astype(np.int32)), pa.array(d2[:, 0])], names=names)

        kind = self.rows.schema[self.vector].dataType.simpleString()
        celled = self.rows.select(self.id_col, self.vector).mapInArrow(run, f"{self.id_col} long, {self.vector} {kind}, cell int, d2 double")
        counts = celled.groupBy("cell").count().orderBy("cell").collect()  # a row for each pivot
        slices = [-(-r["count"] // PIECE_ROWS) for r in counts]
        starts = np.concatenate(([0], np.cumsum(slices)))
        deal = self.spark.createDataFrame([(r["cell"], int(s), k) for r, s, k in zip(counts, starts, slices, strict=False)], "cell int, start int, slices int")
        total = sum(r["count"] for r in counts)
        self.buckets = max(1, min(int(starts[-1]), max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), total // PIECE_ROWS)))
        piece = (F.col("start") + F.pmod(F.xxhash64(self.id_col), F.col("slices"))).cast("int")
        self.vectors = self._write(celled.join(F.broadcast(deal), "cell").select(piece.alias("piece"), F.col(self.id_col), F.col(self.vector), "d2", "cell"), "vectors")
        of = {r["piece"]: r for r in self.vectors.groupBy("piece").agg(F.first("cell").alias("cell"), F.max("d2").alias("d2"), F.count(F.lit(1)).alias("n")).collect()}
        empty = {"cell": 0, "d2": 0.0, "n": 0}
        each = [of.get(k, empty) for k in range(int(starts[-1]))]
        self.pieces = _Pieces(np.array([r["cell"] for r in each]), np.sqrt([r["d2"] for r in each]), np.array([r["n"] for r in each]))
        self.pieces.high[self.pieces.size == 0] = -1.0

    def _refresh(self, which: np.ndarray, pending: np.ndarray, base: int, number: int, work: Work) -> DataFrame:
        """Takes the given pieces up to date with ``pending``, the members from number ``base`` on; returns their rows' ids and distances."""
        pieces, id_col, vector = self.pieces, self.id_col, self.vector
        ids = which.tolist()
        rows = self.vectors.where(F.col("piece").isin(ids)).select("piece", id_col, vector)
        old = [k for k in np.unique(pieces.table[which]).tolist() if k >= 0]
        if old:
            parts = [self.spark.table(f"{self.name}_near{k}").where(F.col("piece").isin(which[pieces.table[which] == k].tolist())) for k in old]
            known = parts[0]
            for part in parts[1:]:
                known = known.unionByName(part)
            rows = rows.join(known.hint("shuffle_hash"), ["piece", id_col], "left").select("piece", id_col, vector, F.coalesce("near", F.lit(math.inf)).alias("near"))
        else:
            rows = rows.withColumn("near", F.lit(math.inf))
        state = (pending, base, self.pivots, pieces.pivot, pieces.radius, np.sqrt(np.maximum(pieces.high, 0)), pieces.upto)
        shared = self.spark.sparkContext.broadcast(state)  # LAG members at most, PIVOTS, and a few numbers for each piece

        def run(batches):
            members, base, pivots, pivot, radius, high, upto = shared.value
            reach: dict[int, np.ndarray] = {}
            tree = Tree(members) if Tree.serves(members) else None
            for batch in batches:
                piece = batch.column(0).to_numpy()
                own, near = matrix(batch.column(2)).astype(np.float64), batch.column(3).to_numpy().copy()
                pairs = 0
                if tree is not None and np.isfinite(own).all():  # a member that a piece has been held against lowers nothing
                    pairs, piece = tree.lower(near, own), piece[:0]
                for p in np.unique(piece).tolist():
                    if p not in reach:
                        new = members[upto[p] - base :]
                        apart = np.sqrt(squared_from(new, pivots[pivot[p]]))
                        reach[p] = new[apart * (1 - 1e-9) <= (radius[p] + high[p]) * (1 + 1e-9)]
                    at = np.flatnonzero(piece == p)
                    if len(at) and len(reach[p]):
                        part = near[at]
                        pairs += relaxed(part, own[at], reach[p])
                        near[at] = part
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near), pa.array(np.where(np.arange(len(near)) == 0, pairs, 0))], names=["piece", id_col, "near", "pairs"])

        found = self._write(rows.mapInArrow(run, f"piece int, {id_col} long, near double, pairs long"), f"near{number}")
        for r in found.groupBy("piece").agg(F.max("near").alias("high"), F.sum("pairs").alias("pairs")).collect():  # a row for each piece
            pieces.high[r["piece"]] = r["high"]
            work.pairs += r["pairs"]
        pieces.upto[which], pieces.table[which] = base + len(pending), number
        work.rows += int(pieces.size[which].sum())
        work.passes += 1
        for k in old:
            if not (pieces.table == k).any():
                self._drop(f"near{k}")
        return found

    def members(self, report: Callable[[int, int], None] | None, work: Work) -> DataFrame:
        spark, id_col, vector, m = self.spark, self.id_col, self.vector, self.m
        schema = f"pick int, {id_col} long, {vector} {self.rows.schema[vector].dataType.simpleString()}"
        self._deal()
        width = self.pivots.shape[1]
        most, lag = min(CANDIDATES, max(1, CANDIDATE_BYTES // (8 * width))), min(LAG, max(1, LAG_BYTES // (8 * width)))
        _, pending = collected(self.rows.where(F.col(id_col) == self.first), id_col, vector)
        first_share = NARROW_SHARE if width <= Tree.WIDTH else SHARE
        picks, written, done, told, base, share, number = [(np.array([self.first]), pending)], None, 1, 0, 0, first_share, 0
        pieces = self.pieces
        while done < m:
            # the pieces of the greatest bounds, and those that would lag too far behind
            which = np.flatnonzero((pieces.size > 0) & (pieces.upto < done) & ((pieces.high >= share**2 * pieces.high.max()) | (done - pieces.upto > lag // 2)))
            if len(which):
                self._refresh(which, pending, base, number, work)
                number += 1
            keep = int(pieces.upto[pieces.size > 0].min())
            pending, base = pending[keep - base :], keep
            # candidates stand in pieces that are up to date; all other rows are bounded
            fresh = np.flatnonzero((pieces.size > 0) & (pieces.upto == done))
            stale = float(pieces.high[(pieces.size > 0) & (pieces.upto < done)].max(initial=-1.0))
            highest = float(pieces.high[fresh].max(initial=-1.0))
            if stale < 0 and highest == 0:  # all rows have members at distance 0
                one, v = collected(self.rows.orderBy(id_col).limit(1), id_col, vector)
                ids, vectors = np.repeat(one, m - done), np.repeat(v, m - done, axis=0)
            elif highest < stale or highest == stale and stale >= 0:
                ids, vectors = np.zeros(0, dtype=np.int64), np.zeros((0, width))
            else:
                ids, vectors = self._pick(fresh, highest, stale, most, m - done, work)
                pending = np.concatenate([pending, vectors])
            share = first_share if len(ids) else share / 2
            picks.append((ids, vectors))
            done += len(ids)
            if report:
                report(done, m)
            if done - told >= PART or done == m:
                part = checkpointed(self._handed(picks, told, schema))
                written, picks, told = part if written is None else written.unionByName(part), [], done
        work.members = m
        for name in list(self.tables):
            self._drop(name[len(self.name) + 1 :])
        removed(spark, self.folder)
        return written if written is not None else self._handed(picks, 0, schema)

    def _handed(self, picks: list[tuple[np.ndarray, np.ndarray]], told: int, schema: str) -> DataFrame:
        """Members on the driver as rows."""
        ids, vectors = (np.concatenate(x) for x in zip(*picks, strict=True))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, vectors.size + 1, vectors.shape[1], dtype=np.int32)), pa.array(vectors.reshape(-1)))
        table = pa.table({"pick": pa.array(np.arange(told, told + len(ids), dtype=np.int32)), self.id_col: pa.array(ids), self.vector: lists})
        return self.spark.createDataFrame(table).select(F.col("pick"), F.col(self.id_col), F.col(self.vector).cast(self.rows.schema[self.vector].dataType)).to(self.spark.createDataFrame([], schema).schema)

    def _pick(self, fresh: np.ndarray, highest: float, stale: float, most: int, wanted: int, work: Work) -> tuple[np.ndarray, np.ndarray]:
        """Members among the rows of up-to-date pieces that no other row can come before: their ids and vectors, in the order in which the greedy method picks them."""
        pieces, id_col, vector = self.pieces, self.id_col, self.vector
        where = fresh[pieces.high[fresh] >= max(stale, 0.0)]
        parts = [self.spark.table(f"{self.name}_near{k}").where(F.col("piece").isin(where[pieces.table[where] == k].tolist())).select("piece", id_col, "near") for k in np.unique(pieces.table[where]).tolist()]
        found = parts[0]
        for part in parts[1:]:
            found = found.unionByName(part)
        levels = [highest * STEP**k for k in range(LEVELS)]
        level = F.ceil(F.log(F.col("near") / highest) / math.log(STEP)).cast("int")
        counted = dict(found.where(F.col("near") >= levels[-1]).groupBy(level.alias("level")).count().collect())  # LEVELS rows at most
        counts = np.cumsum([counted.get(k, 0) for k in range(LEVELS)])
        k = max((k for k in range(LEVELS) if counts[k] <= most), default=-1)
        if k >= 0:
            top, bound = found.where(F.col("near") >= max(levels[k], stale)), max(stale, math.nextafter(levels[k], -1.0))
        else:  # more rows than candidates at one distance
            top, bound = found.where(F.col("near") >= highest).orderBy(id_col).limit(most), highest
        some = self.vectors.where(F.col("piece").isin(where.tolist())).select("piece", id_col, vector)
        candidates = some.join(top.hint("shuffle_hash"), ["piece", id_col]).select(id_col, vector, "near")
        names = [id_col, vector, "place", "pairs"]

        def run(batches):
            table = pa.Table.from_batches(list(batches), schema=None).combine_chunks().sort_by(id_col)
            own = matrix(pa.concat_arrays(table.column(1).chunks)).astype(np.float64)
            chosen, pairs = picked(table.column(0).to_numpy(), own, table.column(2).to_numpy(), bound, True, wanted)
            out = table.take(pa.array(np.array(chosen, dtype=np.int64)))
            n = len(chosen)
            yield from pa.table([out.column(0), out.column(1), pa.array(np.arange(n)), pa.array(np.full(n, pairs))], names=names).combine_chunks().to_batches()

        kind = self.rows.schema[vector].dataType.simpleString()
        table = candidates.repartition(1).mapInArrow(run, f"{id_col} long, {vector} {kind}, place long, pairs long").toArrow().combine_chunks().sort_by("place")
        work.pairs += table.column(3)[0].as_py() if table.num_rows else 0
        return table.column(0).to_numpy(), matrix(pa.concat_arrays(table.column(1).chunks)).astype(np.float64)
