"""Inverted-file index over a bank, and the approximate neighbour join that probes it.

Training is Lloyd's iteration: centroids (as many as configured) are broadcast, each partition gives its clusters' sums,
and the driver only sees one row per cluster. A bank within BROADCAST_BYTES is read once and trained on the driver in the same steps.
Rows keep the cluster of the last assignment, which precedes the last update of the centroids; probing uses the updated centroids.

Rows without a vector are in no cluster, and a query without one has no neighbours.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.vectors import Bank, matrix, squared_matrix, top_k
from lodestone.operators.knn import BROADCAST_BYTES, CHUNK_ROWS, NARROW_ROWS, ROUND_BYTES, Means, _chunks, _together, averaged, averaged_each, bank_bytes, blocked, collected, merged, nearest, passed, records, with_vector
from lodestone.operators.split import seeded
from lodestone.plans.progress import untimed
from lodestone.shared import checkpointed, ship

ITERATIONS = 8
#: Decimals that updated centroids are rounded to, so that the order of partial sums has no effect.
DECIMALS = 9


def effective_clusters(configured: int, n: int) -> int:
    return max(2, min(configured, max(2, n)))


def _own(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of each vector; at equal distance the lower one."""
    return np.argmin(squared_matrix(vectors, centroids), axis=1).astype(np.int32)


def _sums(vectors: np.ndarray, own: np.ndarray, clusters: int) -> tuple[np.ndarray, np.ndarray]:
    total = np.zeros((clusters, vectors.shape[1]))
    np.add.at(total, own, vectors.astype(np.float64))
    return total, np.bincount(own, minlength=clusters)


def assigned(bank: DataFrame, centroids: np.ndarray, id_col: str = "bank_id", vector: str = "emb") -> DataFrame:
    """The bank with ``cluster_id``, its nearest centroid; at equal distance the lower one."""
    ship(bank.sparkSession)
    shared = bank.sparkSession.sparkContext.broadcast(centroids)  # as many rows as clusters are configured

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(_own(matrix(batch.column(1)), shared.value))], names=[id_col, vector, "cluster_id"])

    kind = bank.schema[vector].dataType.simpleString()
    return with_vector(bank, vector).select(F.col(id_col).cast("long").alias(id_col), vector).mapInArrow(run, f"{id_col} long, {vector} {kind}, cluster_id int")


def means(rows: DataFrame, centroids: np.ndarray, vector: str = "emb") -> np.ndarray:
    """Each cluster's mean vector; an empty cluster keeps its centroid."""

    def sums(batches):
        total, count = np.zeros(centroids.shape), np.zeros(len(centroids), dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                more = _sums(matrix(batch.column(0)), batch.column(1).to_numpy(), len(centroids))
                total, count = total + more[0], count + more[1]
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used].tolist(), pa.list_(pa.float64())), pa.array(count[used])], names=["cluster_id", "total", "n"])

    parts = rows.select(vector, "cluster_id").mapInArrow(sums, "cluster_id int, total array<double>, n long")
    summed = parts.select("cluster_id", F.posexplode("total").alias("dim", "x"), "n").groupBy("cluster_id", "dim").agg((F.sum("x") / F.sum("n")).alias("x"))
    out = centroids.copy()
    for r in summed.collect():  # clusters x dimensions
        out[r["cluster_id"], r["dim"]] = round(r["x"], DECIMALS)
    return out


def build(bank: DataFrame, clusters: int = 32, seed: int = 0, iterations: int = ITERATIONS, id_col: str = "bank_id", vector: str = "emb", limit: int = BROADCAST_BYTES) -> tuple[DataFrame, np.ndarray]:
    """The bank with its cluster of the last assignment, and the centroids after the last update. The first centroids are seeded distinct rows."""
    bank = checkpointed(with_vector(bank, vector).select(F.col(id_col).cast("long").alias(id_col), vector))  # read once
    n = bank.count()
    if not n:
        raise ValueError("an empty bank has no index")
    first = bank.orderBy(seeded(seed, F.col(id_col)), id_col).limit(effective_clusters(clusters, n)).select(vector).collect()
    centroids = last = np.array([r[0] for r in first], dtype=np.float64)
    if bank_bytes(bank, vector) <= limit:
        _, vectors = collected(bank, id_col, vector)
        for _ in range(iterations):
            last = centroids
            total, count = _sums(vectors, _own(vectors, last), len(last))
            used = count > 0
            centroids = last.copy()
            centroids[used] = np.round(total[used] / count[used][:, None], DECIMALS)
    else:
        for _ in range(iterations):
            last, centroids = centroids, means(assigned(bank, centroids, id_col, vector), centroids, vector)
    return assigned(bank, last, id_col, vector), centroids


def probes(queries: DataFrame, keys: list[str], centroids: np.ndarray, n: int, vector: str = "emb") -> DataFrame:
    """Per query and probe: keys, vector, ``probe`` (1 the nearest) and ``cluster_id``."""
    ship(queries.sparkSession)
    shared = queries.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                _, ids = top_k(squared_matrix(matrix(batch.column(batch.num_columns - 1)), shared.value), np.arange(len(shared.value)), n)
                rows = pa.array(np.repeat(np.arange(batch.num_rows), ids.shape[1]))
                yield pa.RecordBatch.from_arrays([*(batch.column(j).take(rows) for j in range(batch.num_columns)), pa.array(np.tile(np.arange(1, ids.shape[1] + 1, dtype=np.int32), batch.num_rows)), pa.array(ids.reshape(-1).astype(np.int32))], names=[*keys, vector, "probe", "cluster_id"])

    kinds = ", ".join(f"{c} {queries.schema[c].dataType.simpleString()}" for c in [*keys, vector])
    return with_vector(queries, vector).select(*keys, vector).mapInArrow(run, f"{kinds}, probe int, cluster_id int")


class Cells:
    """A bank by clusters, for queries that probe some of them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, owner: np.ndarray, centroids: np.ndarray):
        self.centroids = centroids
        self.cells = [Bank(vectors[owner == c], ids[owner == c]) for c in range(len(centroids))]
        self.sizes = np.array([len(c.ids) for c in self.cells])
        self.whole = Bank(vectors, ids)

    def nearest(self, queries: np.ndarray, k: int, n_probes: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(queries' numbers, distances, ids) of all queries: only the probed clusters' vectors are looked at, and the whole bank's for queries with under k there.

        A query's nearest cluster comes first, and what it gives bounds what the farther ones may add.
        """
        if n_probes >= len(self.cells):  # all clusters are the whole bank
            return [(np.arange(len(queries)), *self.whole.nearest(queries, k))]
        _, probed = top_k(squared_matrix(queries, self.centroids), np.arange(len(self.centroids)), n_probes)
        enough = self.sizes[probed].sum(axis=1) >= k
        out = []
        few = np.flatnonzero(~enough)
        if len(few):
            out.append((few, *self.whole.nearest(queries[few], k)))
        some = np.flatnonzero(enough)
        if not len(some):
            return out
        asked, probed = queries[some], probed[some]
        near, ids, missing = (np.full((len(some), k), x) for x in (np.inf, 0, True))
        for probe in probed.T:
            found = []
            for c in np.unique(probe).tolist():
                at = np.flatnonzero(probe == c)
                row, d2, more = self.cells[c].within(asked[at], k, near[at, -1])
                found.append((at[row], d2, more))
            row, d2, more = (np.concatenate(x) for x in zip(*found, strict=True))
            changed, place = np.unique(row, return_inverse=True)
            own = np.concatenate([np.repeat(np.arange(len(changed)), k), place])
            every = [np.concatenate([old[changed].reshape(-1), x]) for old, x in ((near, d2), (ids, more), (missing, np.zeros(len(row), dtype=bool)))]
            order = np.lexsort((every[1], every[0], every[2], own))
            take = order[(np.searchsorted(own[order], np.arange(len(changed)))[:, None] + np.arange(k)).reshape(-1)]
            near[changed], ids[changed], missing[changed] = (x[take].reshape(-1, k) for x in every)
        out.append((some, near, ids))
        return out


def shared_cells(indexed: DataFrame, centroids: np.ndarray, id_col: str = "bank_id", vector: str = "emb", limit: int = BROADCAST_BYTES):
    """An index within the limit as a broadcast of ``Cells``, made once, for many calls of ``nearest_probed``; None beyond it."""
    indexed = with_vector(indexed, vector)
    if bank_bytes(indexed, vector) > limit:
        return None
    return indexed.sparkSession.sparkContext.broadcast(Cells(*collected(indexed, id_col, vector, ("cluster_id",)), centroids))


def nearest_probed(queries: DataFrame, keys: list[str], indexed: DataFrame, centroids: np.ndarray, k: int, n_probes: int = 4, id_col: str = "bank_id", vector: str = "emb", limit: int = BROADCAST_BYTES, shared=None, means: Means | None = None, times=untimed) -> DataFrame:
    """As ``knn.nearest``, among the rows of the nearest clusters. A query that finds under k rows there is answered from the whole bank."""
    n_probes = max(1, min(n_probes, len(centroids)))
    spark = queries.sparkSession
    ship(spark)
    queries, indexed = with_vector(queries, vector), with_vector(indexed, vector)
    shared = shared or shared_cells(indexed, centroids, id_col, vector, limit)
    if shared is not None:
        names = keys if means else [*keys, "rank", id_col, "d2"]

        def run(batches):
            cells = shared.value
            step = NARROW_ROWS if cells.whole.tree else 2048
            for whole in _chunks(batches, step) if cells.whole.tree else batches:
                for i in range(0, whole.num_rows if len(cells.whole.ids) else 0, step):
                    batch = whole.slice(i, step)
                    with times("knn"):
                        found = cells.nearest(matrix(batch.column(batch.num_columns - 1)), k, n_probes)
                    for own, near, ids in found:
                        part = batch.take(pa.array(own))
                        yield means.records(part, near, names) if means else records(part, near, ids, names)

        kinds = ", ".join(f"{c} {queries.schema[c].dataType.simpleString()}" for c in keys)
        queries, tree = queries.select(*keys, vector), shared.value.whole.tree
        return (_together(queries, keys, tree.vectors, vector) if tree else queries).mapInArrow(run, f"{kinds}, {means.kinds}" if means else f"{kinds}, rank int, {id_col} long, d2 double")
    candidates = probes(queries, keys, centroids, n_probes, vector).withColumn("cell", F.col("cluster_id"))
    found = merged(blocked(candidates, keys, indexed.withColumn("cell", F.col("cluster_id")), k, id_col, vector), keys, k, id_col)
    found = checkpointed(found)
    full = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).drop("n")
    rest = queries.join(full, keys, "left_anti")
    found = found.join(full, keys, "left_semi").unionByName(nearest(rest, keys, indexed, k, id_col, vector, limit))
    if not means:
        return found
    return averaged_each(found, keys, means.metric, list(means.ks), means.name) if means.name else averaged(found, keys, means.metric)


class Sweep:
    """What a chunk of queries has found so far, for each of several numbers of probes."""

    #: The id of a neighbour not found yet.
    NONE = np.iinfo(np.int64).max

    def __init__(self, queries: np.ndarray, centroids: np.ndarray, sizes: np.ndarray, k: int, probes: Sequence[int]):
        self.queries, self.k, self.probes = np.ascontiguousarray(queries, dtype=np.float64), k, [min(p, len(centroids)) for p in probes]
        _, self.order = top_k(squared_matrix(self.queries, centroids), np.arange(len(centroids)), len(centroids))
        held = sizes[self.order].cumsum(axis=1)
        few = held[:, np.array(self.probes) - 1] < k  # such a query is answered from the whole bank
        self.levels = sorted({*self.probes, *([len(centroids)] if few.any() else [])})
        #: For each query and number of probes the level that answers it, and for each query the clusters that it looks at.
        self.answer = np.where(few, len(self.levels) - 1, np.searchsorted(self.levels, self.probes))
        self.deep = np.array(self.levels)[self.answer].max(axis=1)
        shape = (len(self.levels), len(self.queries), k)
        self.near, self.ids = np.full(shape, np.inf), np.full(shape, self.NONE)

    def meet(self, cells: dict[int, Bank]) -> None:
        """The rows of some clusters, a query's nearest first. What was found bounds what the others may add."""
        for rank in range(self.order.shape[1]):
            level = int(np.searchsorted(self.levels, rank + 1))
            if level == len(self.levels):
                break
            some = np.flatnonzero(self.deep > rank)
            asked = self.order[some, rank]
            for c in np.unique(asked).tolist():
                if c in cells:
                    at = some[asked == c]
                    for row, d2, ids in cells[c].passing(self.queries[at], self.k, lambda at=at: self.near[level, at, -1]):
                        self._add(level, at[row], d2, ids)

    def _add(self, level: int, row: np.ndarray, d2: np.ndarray, ids: np.ndarray) -> None:
        """Pairs of a query and a vector to a level and those that hold it."""
        k = self.k
        for near, known in zip(self.near[level:], self.ids[level:], strict=True):
            kept = ~(d2 > near[row, -1])  # farther than the last of fewer vectors: farther than that of more, too
            row, d2, ids = row[kept], d2[kept], ids[kept]
            if not len(row):
                return
            changed, place = np.unique(row, return_inverse=True)
            own = np.concatenate([np.repeat(np.arange(len(changed)), k), place])
            every, each = np.concatenate([near[changed].reshape(-1), d2]), np.concatenate([known[changed].reshape(-1), ids])
            order = np.lexsort((each, every, each == self.NONE, own))
            take = order[(np.searchsorted(own[order], np.arange(len(changed)))[:, None] + np.arange(k)).reshape(-1)]
            near[changed], known[changed] = every[take].reshape(-1, k), each[take].reshape(-1, k)

    def found(self, number: int, rows: slice, total: int) -> np.ndarray:
        """The distances of some queries for one of the numbers of probes, nearest first; ``total`` rows are in the bank."""
        at = np.arange(len(self.queries))[rows]
        return self.near[self.answer[at, number], at][:, : min(self.k, total)]


def swept(
    queries: DataFrame, keys: list[str], indexed: DataFrame, centroids: np.ndarray, k: int, probes: Sequence[int], metric: str, name: str, id_col: str = "bank_id", vector: str = "emb", limit: int = BROADCAST_BYTES, shared=None, round_bytes: int = ROUND_BYTES, times=untimed
) -> DataFrame:
    """Per query and number of probes (``name``): ``dist``, the mean over what ``nearest_probed`` finds.

    One pass serves all numbers: the clusters of fewer probes are the first of more. An index beyond ``limit`` bytes comes round in blocks of about that size, each of a few
    clusters or a part of one; queries are not copied. Only beyond ``round_bytes`` each number of probes is searched by itself.
    """
    spark = queries.sparkSession
    ship(spark)
    queries, indexed = with_vector(queries, vector).select(*keys, vector), with_vector(indexed, vector)
    probes = [max(1, p) for p in probes]
    shared = shared or shared_cells(indexed, centroids, id_col, vector, limit)
    if shared is not None:
        sizes, blocks, tree = shared.value.sizes, [shared], shared.value.whole.tree
        queries = _together(queries, keys, tree.vectors, vector) if tree else queries
    else:
        bytes_ = bank_bytes(indexed, vector)
        if bytes_ > round_bytes:
            means = Means(metric, (k,))
            return reduce(DataFrame.unionByName, (nearest_probed(queries, keys, indexed, centroids, k, p, id_col, vector, limit, means=means, times=times).withColumn(name, F.lit(p)) for p in probes))
        sizes = np.zeros(len(centroids), dtype=np.int64)
        for r in indexed.groupBy("cluster_id").count().collect():  # a row for each cluster
            sizes[r["cluster_id"]] = r["count"]
        blocks = _blocks(indexed, sizes, max(1, -(-bytes_ // max(1, limit or BROADCAST_BYTES))), id_col, vector)
        # the work for a query is the same for all, so that tasks of equal rows are done at the same time
        queries = queries.repartition(4 * spark.sparkContext.defaultParallelism)
    total, names = int(sizes.sum()), [*keys, name, "dist"]
    kinds = ", ".join(f"{c} {queries.schema[c].dataType.simpleString()}" for c in keys)

    def run(batches):
        narrow = shared is not None and shared.value.whole.tree is not None
        for chunk in _chunks(batches, NARROW_ROWS // 2 if narrow else CHUNK_ROWS):
            with times("knn"):
                sweep = Sweep(matrix(chunk.column(chunk.num_columns - 1)), centroids, sizes, k, probes)
                for block in blocks:
                    cells = block.value
                    if shared is None:
                        block.__dict__.pop("_value", None)  # a worker keeps one block, not all that it has seen
                    sweep.meet(cells if shared is None else dict(enumerate(cells.cells)))
            for i in range(0, chunk.num_rows, 2048):
                part = chunk.slice(i, 2048)
                for j, p in enumerate(probes):
                    yield Means(metric, (k,)).records(part, sweep.found(j, slice(i, i + 2048), total), keys).add_column(len(keys), name, pa.array(np.full(part.num_rows, p, dtype=np.int32))).select(names)

    return queries.mapInArrow(run, f"{kinds}, {name} int, dist double")


def _blocks(indexed: DataFrame, sizes: np.ndarray, n: int, id_col: str, vector: str) -> list:
    """Broadcasts of about n blocks of an index: clusters in their order, by rows of about the same number. One block at a time passes the driver."""
    spark = indexed.sparkSession
    starts, own = np.concatenate(([0], np.cumsum(sizes)[:-1])).tolist(), F.col("cluster_id") + 1
    place = F.element_at(F.lit(starts), own) + F.pmod(F.xxhash64(id_col), F.element_at(F.lit(sizes.tolist()), own))
    each = -(-int(sizes.sum()) // n)
    dealt = indexed.select(F.floor(place / each).cast("int").alias("block"), F.col(id_col).cast("long").alias(id_col), vector, "cluster_id")

    def made(rows: DataFrame):
        ids, vectors, owner = collected(rows, id_col, vector, ("cluster_id",))
        return spark.sparkContext.broadcast({c: Bank(vectors[owner == c], ids[owner == c]) for c in np.unique(owner).tolist()})

    return passed(dealt, n, made)


def uses_index(use_ann: bool, n: int, clusters: int) -> bool:
    """The index serves if asked for and the bank has at least as many rows as clusters."""
    return use_ann and n >= clusters
