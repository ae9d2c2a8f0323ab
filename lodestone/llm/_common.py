"""Plumbing shared by the operators of this subpackage."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.shared import checkpointed, read, ship

__all__ = ["LOWER", "arrow_map", "block_pairs", "blocks", "checkpointed", "crc_of_id", "kept", "mapped", "offsets", "parts_of", "ragged", "raw", "read", "words"]

#: Text that a Python worker holds as one block; long record batches are cut to this.
BLOCK_BYTES = 4 << 20
#: Rows of a record batch, where the session has Spark's default of 10,000.
BATCH_ROWS = "4000"

_KEPT: dict[str, object] = {}


def kept(name: str, make: Callable):
    """A worker's state that outlives a task, such as a vocabulary's cache. A worker keeps one at a time: asking for another frees it."""
    if name not in _KEPT:
        _KEPT.clear()
        gc.collect()
        _KEPT[name] = make()
    return _KEPT[name]

#: A-Z to a-z, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def arrow_map(df: DataFrame, columns: list, fn: Callable, schema) -> DataFrame:
    """``fn`` over Arrow record batches of only the named columns.

    Selecting first keeps clashing extra columns of the caller out of the operator, and out of
    the scan. Batches are kept small, as a worker's memory holds a batch beside the JVM's copy.
    """
    spark = df.sparkSession
    ship(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return df.select(*columns).mapInArrow(fn, schema)


def blocks(batches: Iterator[pa.RecordBatch], text: int, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that column ``text`` has about ``most`` bytes in each; null texts become empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(text)
        if pa.types.is_large_string(column.type):
            column = column.cast(pa.string())
        column = pc.fill_null(column, "")
        batch = pa.RecordBatch.from_arrays([column if i == text else batch.column(i) for i in range(batch.num_columns)], names=batch.schema.names)
        ends = offsets(column)[1:].astype(np.int64)
        start, base = 0, int(offsets(column)[0])
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(start, stop - start)
            base, start = int(ends[stop - 1]), stop


#: Rows of a group that are one block whatever the group's size.
ONE_BLOCK = 256


def parts_of(rows: str, most: int):
    """Blocks of a group from its number of rows: a block grows with the group's root, up to ``most``, so that a group spreads over many tasks."""
    block = F.least(F.lit(most), F.greatest(F.lit(ONE_BLOCK), F.ceil(3 * F.sqrt(F.col(rows)))))
    return F.greatest(F.lit(1), F.ceil(F.col(rows) / block)).cast("int")


def block_pairs(rows: DataFrame, group: str) -> DataFrame:
    """Rows (``node``, a group, its number of ``parts``) dealt into ``parts`` blocks, a copy for each pair of blocks: ``key`` of the pair and ``side`` (0 or 1)."""
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int")))
    dealt = rows.withColumn("own", own).withColumn("other", other)
    low, high = F.least("own", "other"), F.greatest("own", "other")
    return dealt.withColumn("key", F.xxhash64(group, low, high)).withColumn("side", (F.col("own") > F.col("other")).cast("int"))


def offsets(strings: pa.Array) -> np.ndarray:
    """Byte offsets of a (sliced) string array."""
    return np.frombuffer(strings.buffers()[1], dtype=np.int32)[strings.offset : strings.offset + len(strings) + 1]


def raw(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all values and their offsets from 0."""
    at = offsets(strings)
    data = strings.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[at[0] : at[-1]], (at - at[0]).astype(np.int32)


def mapped(strings: pa.Array, table: np.ndarray) -> pa.Array:
    """The values with each byte looked up in ``table``; it must leave bytes over 127 alone."""
    data, at = raw(strings)
    return pa.Array.from_buffers(pa.string(), len(strings), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(table[data].tobytes())])


def words(strings: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words between ASCII white space (codes 9 to 13 and 32): their codes, each text's offsets, the distinct words."""
    split = pc.ascii_split_whitespace(strings)
    coded = split.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32, copy=False)
    at = split.offsets.to_numpy().astype(np.int64)
    at = at - at[0]
    empty = pc.index(coded.dictionary, "").as_py()
    if empty >= 0:  # of white space at either end
        keep = codes != empty
        at = np.concatenate(([0], np.cumsum(keep)))[at]
        codes = codes[keep]
    return codes, at, coded.dictionary


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the runs ``starts[i] .. starts[i] + lengths[i]``, one run after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total < 2**31 and (not len(starts) or int(starts.max()) < 2**31) else np.int64
    return np.repeat((starts - (ends - lengths)).astype(kind), lengths) + np.arange(total, dtype=kind)


def crc_of_id(column: str):
    """crc32 of an id written as text, the key of the labelled folds."""
    return F.crc32(F.col(column).cast("string").cast("binary"))
