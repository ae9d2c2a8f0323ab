"""Exact k-nearest-neighbour joins.

A bank whose vectors are within BROADCAST_BYTES goes to every worker, and queries never move. A larger bank comes round in blocks of that size, one
at a time: each block is a broadcast of its own, a worker holds one of them beside a chunk of its queries, and a chunk keeps the k nearest
rows so far while the blocks pass. Queries stay where they are and no vector is copied or shuffled. Broadcasts stand on the executors' disks while a
round of them is in use; beyond ROUND_BYTES there are several rounds, and a grouping merges a few neighbours of each. In both
ways distances are numpy differences in double.

``mean_distances`` takes the mean over a query's neighbours where they are found, so that one row a query leaves the worker.

A query without a vector has no neighbours, and a bank row without one is nobody's neighbour.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.vectors import Bank, average_of, matrix
from lodestone.plans.progress import untimed
from lodestone.shared import removed, shared_folder, ship

BROADCAST_BYTES = 64 << 20
#: Bytes of a bank that passes in one round of blocks, and queries that a worker holds while it does.
ROUND_BYTES, CHUNK_ROWS = 4 << 30, 16_384
#: Queries that a worker holds beside a bank of few dimensions: the more there are, the closer together lie those that are held against the same boxes.
NARROW_ROWS = 131_072
#: Vectors around which such queries are dealt, and tasks for those around one.
PIVOTS, SHARES = 1024, 4
#: Rows of a bank block, and queries of a part, of clusters beyond that.
BLOCK_ROWS, PART_ROWS = 50_000, 20_000


def records(batch: pa.RecordBatch, near: np.ndarray, ids: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """A row for each query (the batch's columns but the last) and neighbour: keys, rank, id and squared distance."""
    n, k = near.shape
    keys = [batch.column(j).take(pa.array(np.repeat(np.arange(n), k))) for j in range(batch.num_columns - 1)]
    return pa.RecordBatch.from_arrays([*keys, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(ids.reshape(-1)), pa.array(near.reshape(-1))], names=names)


@dataclass(frozen=True)
class Means:
    """What becomes of a query's neighbours: the mean distance over the first k of them, for each k (in column ``name`` if that is given)."""

    metric: str
    ks: tuple[int, ...]
    name: str | None = None

    @property
    def columns(self) -> list[str]:
        return [*((self.name,) if self.name else ()), "dist"]

    @property
    def kinds(self) -> str:
        return (f"{self.name} int, " if self.name else "") + "dist double"

    def records(self, batch: pa.RecordBatch, near: np.ndarray, keys: list[str]) -> pa.RecordBatch:
        """A row for each query (the batch's columns but the last) and k. Distances are summed from the nearest on."""
        sums = np.cumsum(np.sqrt(near) if self.metric == "squared_euclidean" else near, axis=1)
        counts = np.minimum(self.ks, near.shape[1])
        dist = sums[:, counts - 1] / counts
        n, m = dist.shape
        out = [batch.column(j).take(pa.array(np.repeat(np.arange(n), m))) for j in range(batch.num_columns - 1)]
        named = [pa.array(np.tile(np.array(self.ks, dtype=np.int32), n))] if self.name else []
        return pa.RecordBatch.from_arrays([*out, *named, pa.array(dist.reshape(-1))], names=[*keys, *self.columns])


def _kernel(bank: Bank, k: int, names: list[str], means: Means | None = None, times=untimed, most: int = 2048):
    step = NARROW_ROWS if bank.tree else most

    def rows(batch):
        queries = matrix(batch.column(batch.num_columns - 1), bank.vectors.shape[1])
        for i in range(0, batch.num_rows if len(bank.ids) else 0, step):
            with times("knn"):
                near, ids = bank.nearest(queries[i : i + step], k)
            for j in range(0, len(near), most):
                part = batch.slice(i + j, min(most, len(near) - j))
                yield means.records(part, near[j : j + most], names) if means else records(part, near[j : j + most], ids[j : j + most], names)

    return rows


def with_vector(rows: DataFrame, vector: str) -> DataFrame:
    return rows.where(F.col(vector).isNotNull())


def collected(bank: DataFrame, id_col: str = "bank_id", vector: str = "emb", more: tuple[str, ...] = ()) -> tuple[np.ndarray, ...]:
    """A bank known to be small, sorted by id, on the driver: ids, vectors and further columns."""
    table = bank.select(F.col(id_col).cast("long").alias("id"), vector, *more).toArrow().combine_chunks().sort_by("id")
    flat = table.column(1).combine_chunks()
    flat = flat if isinstance(flat, pa.Array) else pa.concat_arrays(flat.chunks)
    return (table.column(0).to_numpy(), matrix(flat).astype(np.float64), *(table.column(2 + k).to_numpy() for k in range(len(more))))


def bank_bytes(bank: DataFrame, vector: str = "emb") -> int:
    return int(bank.agg(F.sum(F.size(vector) * 8)).first()[0] or 0)


def shared_bank(bank: DataFrame, id_col: str = "bank_id", vector: str = "emb", limit: int = BROADCAST_BYTES):
    """A bank within the limit as a broadcast, for many calls of ``nearest``; None beyond it."""
    bank = with_vector(bank, vector)
    return _broadcast(bank, id_col, vector) if bank_bytes(bank, vector) <= limit else None


def _broadcast(bank: DataFrame, id_col: str, vector: str):
    """A bank known to be small, with its boxes if it has any: these are made once."""
    ids, rows = collected(bank, id_col, vector)
    return bank.sparkSession.sparkContext.broadcast(Bank(rows, ids))


def nearest(
    queries: DataFrame, keys: list[str], bank: DataFrame, k: int, id_col: str = "bank_id", vector: str = "emb", limit: int = BROADCAST_BYTES, shared=None, means: Means | None = None, round_bytes: int = ROUND_BYTES, times=untimed
) -> DataFrame:
    """Per query and neighbour: the keys, ``rank`` from 1, the bank's id and ``d2``. At equal distance the lower id comes first.

    A bank of fewer than k rows gives fewer neighbours; an empty bank gives none. ``shared`` is the bank's ``shared_bank``, if that is at hand. Beyond
    ``limit`` bytes the bank comes in blocks of about that size. ``means`` gives the rows of ``mean_distances`` instead.
    """
    spark = queries.sparkSession
    ship(spark)
    queries, bank = with_vector(queries, vector), with_vector(bank, vector)
    kinds = ", ".join(f"{c} {queries.schema[c].dataType.simpleString()}" for c in keys)
    names = keys if means else [*keys, "rank", id_col, "d2"]
    schema = f"{kinds}, {means.kinds}" if means else f"{kinds}, rank int, {id_col} long, d2 double"
    size = None if shared is not None else bank_bytes(bank, vector)
    if shared is None and size <= limit:
        shared = _broadcast(bank, id_col, vector)
    if shared is not None:

        def run(batches):
            kernel = _kernel(shared.value, k, names, means, times)
            for batch in _chunks(batches, NARROW_ROWS) if shared.value.tree else batches:
                yield from kernel(batch)

        queries = queries.select(*keys, vector)
        return (_together(queries, keys, shared.value.tree.vectors, vector) if shared.value.tree else queries).mapInArrow(run, schema)
    rounds = _rounds(bank, id_col, vector, size, limit or BROADCAST_BYTES, max(1, round_bytes))
    if len(rounds) <= 1:
        return queries.select(*keys, vector).mapInArrow(_passing(rounds[0] if rounds else [], k, names, means, times), schema)
    plain = f"{kinds}, rank int, {id_col} long, d2 double"
    found = None
    for blocks in rounds:
        part = queries.select(*keys, vector).mapInArrow(_passing(blocks, k, [*keys, "rank", id_col, "d2"], None, times), plain)
        found = part if found is None else found.unionByName(part)
    found = merged(found, keys, k, id_col)
    if not means:
        return found
    return averaged_each(found, keys, means.metric, list(means.ks), means.name) if means.name else averaged(found, keys, means.metric)


def _together(queries: DataFrame, keys: list[str], near: np.ndarray, vector: str) -> DataFrame:
    """The queries, dealt so that those near the same of a few vectors of ``near`` (which lie in order of boxes) are in the same tasks, and a crowd of them in several."""
    spark = queries.sparkSession
    pivots = near[:: max(1, len(near) // PIVOTS)]
    bank = spark.sparkContext.broadcast(Bank(pivots, np.arange(len(pivots))))
    names, width = [*keys, vector, "cell"], pivots.shape[1]

    def run(batches):
        for batch in batches:
            _, cell = bank.value.nearest(matrix(batch.column(batch.num_columns - 1), width), 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell[:, 0].astype(np.int32))], names=names)

    kinds = ", ".join(f"{c} {queries.schema[c].dataType.simpleString()}" for c in [*keys, vector])
    celled = queries.mapInArrow(run, f"{kinds}, cell int")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return celled.repartition(parts, "cell", F.pmod(F.xxhash64(*keys), F.lit(SHARES))).drop("cell")


def mean_distances(queries: DataFrame, keys: list[str], bank: DataFrame, metric: str, ks: Sequence[int], name: str | None = None, **rest) -> DataFrame:
    """Per query: ``dist``, the mean over its k nearest in ascending order; for several k a row for each (``name``). The rest is ``nearest``'s."""
    return nearest(queries, keys, bank, max(ks), means=Means(metric, tuple(ks), name), **rest)


def _rounds(bank: DataFrame, id_col: str, vector: str, size: int, block_bytes: int, round_bytes: int) -> list[list]:
    """Broadcasts of the bank's blocks, by round. The bank is dealt into blocks once, and one block at a time passes the driver."""
    n = max(1, -(-size // block_bytes))
    dealt = bank.select(F.pmod(F.xxhash64(id_col, vector), F.lit(n)).cast("int").alias("block"), F.col(id_col).cast("long").alias(id_col), vector)
    blocks = passed(dealt, n, lambda rows: _broadcast(rows, id_col, vector))
    each = max(1, round_bytes // block_bytes)
    return [blocks[i : i + each] for i in range(0, len(blocks), each)]


def passed(dealt: DataFrame, n: int, made: Callable[[DataFrame], object]) -> list:
    """What ``made`` makes of each of about ``n`` ``block``s of rows, one after the other."""
    spark = dealt.sparkSession
    path = f"{shared_folder(spark)}/bank-{uuid.uuid4().hex}"
    dealt.repartition(min(n, 1000), "block").write.partitionBy("block").parquet(path)
    schema = dealt.drop("block").schema
    blocks = [made(spark.read.schema(schema).parquet(f"{path}/block={k}")) for k in sorted(r[0] for r in spark.read.parquet(path).select("block").distinct().collect())]
    removed(spark, path)
    return blocks


def _passing(blocks: list, k: int, names: list[str], means: Means | None, times=untimed) -> Callable:
    """A chunk of queries at a time, held against one block after the other; what it keeps are its k nearest so far."""

    def run(batches: Iterator[pa.RecordBatch]):
        narrow = bool(blocks) and blocks[0].value.tree is not None
        for chunk in _chunks(batches, NARROW_ROWS if narrow else CHUNK_ROWS) if blocks else ():
            queries = matrix(chunk.column(chunk.num_columns - 1)).astype(np.float64)
            near, ids = np.empty((len(queries), 0)), np.empty((len(queries), 0), dtype=np.int64)
            for block in blocks:
                with times("knn"):
                    bank = block.value
                    block.__dict__.pop("_value", None)  # a worker keeps one block, not all that it has seen
                    d2, found = bank.nearest(queries, k)
                    near, ids = np.concatenate([near, d2], axis=1), np.concatenate([ids, found], axis=1)
                    order = np.lexsort((ids, near), axis=1)[:, :k]
                    near, ids = np.take_along_axis(near, order, axis=1), np.take_along_axis(ids, order, axis=1)
            for i in range(0, chunk.num_rows, 2048):
                part = chunk.slice(i, 2048)
                yield means.records(part, near[i : i + 2048], names) if means else records(part, near[i : i + 2048], ids[i : i + 2048], names)

    return run


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0
    for batch in batches:
        for i in range(0, batch.num_rows, most):
            held.append(batch.slice(i, most))
            rows += held[-1].num_rows
            if rows >= most:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, rows = [], 0
    if rows:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def blocked(queries: DataFrame, keys: list[str], bank: DataFrame, k: int, id_col: str, vector: str, block_rows: int = BLOCK_ROWS, part_rows: int = PART_ROWS) -> DataFrame:
    """Neighbours among rows of the same ``cell``: each (cell, part of queries, block of bank) is one task of bounded size."""
    queries, bank = with_vector(queries, vector), with_vector(bank, vector)
    parts = queries.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / part_rows).cast("int").alias("parts"))
    sizes = bank.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))
    shape = parts.join(sizes, "cell")
    row_key = F.xxhash64(*keys)
    q = queries.join(shape, "cell").withColumn("part", F.pmod(row_key, F.col("parts")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    b = bank.join(shape, "cell").withColumn("block", F.pmod(F.xxhash64(id_col), F.col("blocks")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    kinds = ", ".join(f"{c} {queries.schema[c].dataType.simpleString()}" for c in keys)
    names = [*keys, "rank", id_col, "d2"]

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks().sort_by(id_col)
        vectors = lambda t: matrix(pa.concat_arrays(t.column(vector).chunks)) if t.num_rows else np.empty((0, 0))
        kernel = _kernel(Bank(vectors(right), right.column(id_col).to_numpy()), k, names)
        out = [x for batch in left.select([*keys, vector]).to_batches() for x in kernel(batch)]
        return pa.Table.from_batches(out) if out else pa.table({n: pa.array([], left.schema.field(n).type if n in keys else t) for n, t in zip(names, [None] * len(keys) + [pa.int32(), pa.int64(), pa.float64()], strict=True)})

    cell = ["cell", "part", "block"]
    left = q.select(*cell, *keys, vector).groupBy(*cell)
    right = b.select(*cell, F.col(id_col).cast("long").alias(id_col), vector).groupBy(*cell)
    return left.cogroup(right).applyInArrow(both, f"{kinds}, rank int, {id_col} long, d2 double")


def merged(found: DataFrame, keys: list[str], k: int, id_col: str = "bank_id") -> DataFrame:
    """The k nearest of each query among neighbours found in several places."""
    order = Window.partitionBy(*keys).orderBy("d2", id_col)
    return found.drop("rank").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(*keys, "rank", id_col, "d2")


def _listed(neighbours: DataFrame, keys: list[str]) -> DataFrame:
    """Per query: ``near``, its squared distances in ascending order."""
    squared = F.transform(F.sort_array(F.collect_list(F.struct("rank", "d2"))), lambda p: p["d2"])
    return neighbours.groupBy(*keys).agg(squared.alias("near"))


def averaged(neighbours: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """Per query: ``dist``, the mean over its neighbours in ascending order."""
    return _listed(neighbours, keys).select(*keys, average_of(F.col("near"), metric).alias("dist"))


def averaged_each(neighbours: DataFrame, keys: list[str], metric: str, ks: list[int], name: str) -> DataFrame:
    """Per query and k (``name``): ``dist``, the mean over its first k neighbours. One grouping serves all k."""
    rows = _listed(neighbours, keys).withColumn(name, F.explode(F.array(*map(F.lit, ks))))
    return rows.select(*keys, name, average_of(F.slice("near", 1, F.col(name)), metric).alias("dist"))


def image_scores(patch_scores: DataFrame, id_col: str = "image_id", by: Sequence[str] = ()) -> DataFrame:
    """Per image (and group of ``by``): ``score``, the greatest patch distance."""
    return patch_scores.groupBy(id_col, *by).agg(F.max("dist").alias("score"))
