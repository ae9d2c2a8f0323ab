"""Connected components of a distributed edge table.

Edges are first contracted in blocks (union-find, so a block of up to BLOCK edges gives at most one edge per
node it saw), then large-star and small-star rounds alternate until the edges are stars around
the least node of each component. Every round is checkpointed in the shared folder. Links and labels never go to the driver; only
one row of sums per round does, to see whether anything changed.

Null ends are dropped; self-loops and repeated edges change nothing; no edges give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import arrow_map, checkpointed

#: Edges that a task contracts at once.
BLOCK = 1_000_000


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars around the least node of each component of a few edges."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:  # hooking to the least neighbour, then pointer jumping
        before = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while (label[label] != label).any():
            label = label[label]
        if (label == before).all():
            break
    own = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[own], nodes[label[own]]


def _contracted(batches):
    held, size = [], 0

    def out():
        a, b = contract(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        size += batch.num_rows
        if size > BLOCK:
            yield out()
            held, size = [], 0
    if size:
        yield out()


def connected_components(edges: DataFrame) -> DataFrame:
    """Per node of the edges (``a``, ``b`` long): ``node`` and ``root``, the least node that it reaches."""
    edges = checkpointed(edges.select("a", "b").where("a is not null and b is not null and a != b"))
    tasks = max(1, -(-edges.count() // BLOCK))  # as few as the bound of a task's edges allows: the more a task sees, the more it contracts
    edges = checkpointed(arrow_map(edges.coalesce(tasks), ["a", "b"], _contracted, "a long, b long"))
    last = None
    while True:
        # large star: a node's greater neighbours move to its least neighbour
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).withColumnRenamed("a", "n")
        large = both.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        # small star: a node and its smaller neighbours move to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        small = large.join(least, F.col("a") == F.col("n"))
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b")))
        edges = checkpointed(small.distinct())
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1_000_003)).first()
        if now == last:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        last = now
