"""Document fingerprints by MinHash.

A text's shingles are runs of SHINGLE lower-cased words (all words, if there are fewer). Each shingle's hash goes through PERMUTATIONS
universal hash permutations ``a * x + b`` modulo 2**32 with odd a, in numpy over all texts of a block at once, and each keeps
its minimum. A fingerprint has a scrambled byte of each minimum; two fingerprints' likeness is the share of equal bytes, less what
chance gives.

Near duplicates: bands of the full signature are joined in Spark. The texts of a bucket are compared by their fingerprints, in blocks if they are many;
what those connect is a candidate class, and the Jaccard similarity of the shingle sets verifies all its pairs.

Results in special cases: a null or empty text has no shingles and a fingerprint of its own, equal to that of any empty text; very
long texts count whole; repeated rows each get their row, the same texts the same fingerprint; rows without an
id come last in the order of documents; an empty table gives an empty result; columns other than
the id and the text are never read.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections import Counter
from collections.abc import Callable
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from lodestone.llm._common import LOWER, arrow_map, block_pairs, blocks, checkpointed, kept, mapped, parts_of, raw, words
from lodestone.llm.components import connected_components, contract

SHINGLE = 5
PERMUTATIONS = 128
LEAST = 0.8
#: Bands of the signature: texts of the similarity LEAST share one with a chance over 0.999.
BANDS = 32
#: What the likeness of a bucket's texts may fall short of their similarity: at LEAST more has a chance under 1e-12.
SLACK = 0.3
#: Rows of one id and text from which they are folded, and rows for each range that quantiles of ids other than numbers are taken from.
OFTEN, SAMPLE = 10_000, 64
#: Passes over crowded buckets with a pivot each, before blocks; another pass must have settled this share of their rows.
PIVOTS, SETTLED = 6, 0.05
#: Distinct texts of a bucket that one task compares with as many others at once, at most.
MOST = 2000


@lru_cache(maxsize=1)
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(20_240_501)
    return (random.integers(0, 2**31, PERMUTATIONS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1), random.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32)


class _Hashes:
    """64-bit hashes of distinct words, from slices of their bytes: strings of Python and a dictionary of words seen before took three times as long."""

    def __call__(self, found: pa.Array) -> np.ndarray:
        import xxhash

        digest = xxhash.xxh64_intdigest
        data, at = raw(found)
        data, at = data.tobytes(), at.tolist()
        return np.fromiter((digest(data[i:j], 42) for i, j in pairwise(at)), np.uint64, len(found))


def shingles(texts: pa.Array, hashes: _Hashes, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all shingles of the texts, repeats included, and each text's offsets."""
    codes, at, distinct = words(mapped(texts, LOWER))
    own = hashes(distinct)
    sizes = np.diff(at)
    h = own[codes] if len(codes) else np.zeros(0, dtype=np.uint64)
    rolled = np.zeros(len(h), dtype=np.uint64)
    multiplier = np.uint64(0x9E3779B97F4A7C15)
    for k in range(width):  # a run cut by the end of the text is short: it is masked below, or is the whole text
        rolled = rolled * multiplier
        if k < len(h):
            rolled[: len(h) - k] += h[k:]
    room = np.repeat(at[1:], sizes) - np.arange(len(h))
    keep = room >= width
    short = np.flatnonzero((sizes > 0) & (sizes < width))
    for i in short.tolist():
        value = int(sizes[i])
        for x in h[at[i] : at[i + 1]].tolist():
            value = (value * int(multiplier) + x) % 2**64
        rolled[at[i]], keep[at[i]] = value, True
    counts = np.where(sizes < width, (sizes > 0).astype(np.int64), sizes - width + 1)
    rolled = rolled[keep]
    rolled ^= rolled >> np.uint64(29)
    rolled *= np.uint64(0xBF58476D1CE4E5B9)
    rolled ^= rolled >> np.uint64(32)
    return rolled, np.concatenate(([0], np.cumsum(counts)))


def signatures(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Minima of the permuted hashes: a row for each text, and all ones where it has no shingle."""
    out = np.full((len(at) - 1, PERMUTATIONS), 0xFFFFFFFF, dtype=np.uint32)
    full = np.flatnonzero(np.diff(at))
    if not len(full):
        return out
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    a, b = _permutations()
    starts = at[:-1][full]
    step = np.empty_like(x)
    for k in range(PERMUTATIONS):
        np.multiply(x, a[k], out=step)
        step += b[k]
        out[full, k] = np.minimum.reduceat(step, starts)
    return out


def bytes_of(signature: np.ndarray) -> np.ndarray:
    """A scrambled byte of each minimum."""
    x = signature * np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    return (x >> np.uint32(24)).astype(np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity from the share of equal bytes, row by row."""
    return np.maximum(0.0, ((a == b).mean(axis=-1) - 1 / 256) / (1 - 1 / 256))


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by the first as many code points of the following text."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def fingerprint_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited`` and ``near_next``.

    The next document is that of the next smaller id (after the last: the first); rows of one id follow by their text's hash, rows
    without an id come last. Ids may be of any type that sorts. Of rows that repeat an id and a text over OFTEN times two go through, as all but the last have their own text
    next; the rest are made from the first of them. Rows are dealt into ranges of this order: quantiles of the ids begin ranges, and an id that is several quantiles,
    like the rows without one, has as many ranges of hashes. The first row of a range also goes to the range before it, so ranges need nothing from each other, and
    texts move once.
    """
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text")).withColumn("weight", F.lit(1).cast("long"))
    often = checkpointed(rows.groupBy("id", "hash").count().where(F.col("count") > OFTEN))
    repeats = not often.isEmpty()
    if repeats:
        rows = _folded(rows, often)
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranges = 4 * n
    known = F.col("id").isNotNull()
    numbers = isinstance(df.schema[id_col].dataType, NumericType)
    middle = F.percentile_approx(F.when(known, F.col("id")), [k / ranges for k in range(1, ranges)], max(10_000, 10 * ranges)) if numbers else F.lit(None)
    quantiles, n_known, n_all = rows.agg(middle, F.count("id"), F.count(F.lit(1))).first()
    if not numbers:  # of a bounded sample: the rows with the least hashes
        some = sorted(r[0] for r in rows.where(known).orderBy(F.xxhash64("id", "hash"), "id").limit(SAMPLE * ranges).select("id").collect())
        quantiles = [some[len(some) * k // ranges] for k in range(1, ranges)] if some else []
    times = Counter(quantiles or [])
    bounds = sorted(times, reverse=True)  # ids that occur: each begins a range, in descending order
    # ranges of hashes that the bound before each place has, and the first range of each place; behind all, those without an id
    parts = [1, *(times[b] for b in bounds), max(1, ranges * (n_all - n_known) // max(1, n_all))]
    begins = [sum(parts[:k]) for k in range(len(parts))]
    # a row's place is the number of bounds that are not below its id, found among every STEP-th bound and then in that step
    step = max(1, math.isqrt(len(bounds)))
    held = lambda values, form: F.from_json(F.lit(json.dumps(values, default=str)), form.format("string")).cast(form.format(kind))
    coarse = held(bounds[step - 1 :: step], "array<{}>")
    fine = held([bounds[k : k + step] for k in range(0, len(bounds) + 1, step)], "array<array<{}>>")
    full = F.size(F.filter(coarse, lambda b: b >= F.col("id")))
    place = F.when(known, full * step + F.size(F.filter(F.get(fine, full), lambda b: b >= F.col("id")))).otherwise(len(bounds) + 1)
    at = lambda values: F.get(F.from_json(F.lit(json.dumps(values)), "array<int>"), F.col("place"))
    of_bound = held([None, *bounds, None], "array<{}>")
    share = F.floor((F.col("hash") / 2.0**64 + 0.5) * at(parts)).cast("int")  # hashes ascend along an id's ranges
    inside = F.when(F.get(of_bound, F.col("place")).eqNullSafe(F.col("id")) & (at(parts) > 1), F.least(share, at(parts) - 1)).otherwise(F.when(known, at(parts) - 1).otherwise(0))
    placed = rows.withColumn("place", place).withColumn("range", at(begins) + inside)
    # the first row of each range: at most a row for each range comes to the driver
    firsts = placed.groupBy("range").agg(F.max_by(F.struct("id", "hash"), F.struct(known, "id", F.bitwise_not("hash"))).alias("first")).select("range", "first.*").collect()
    firsts.sort(key=lambda r: r["range"])
    last = firsts[-1]["range"] if firsts else 0
    heads = [(r["id"], r["hash"], [firsts[k - 1]["range"]] if k else [], [last] if not k else []) for k, r in enumerate(firsts)]
    heads = spark.createDataFrame(heads, f"first_id {kind}, first_hash long, before array<int>, wrapped array<int>")
    own = lambda column, extra: F.transform(F.coalesce(F.col(column), F.array().cast("array<int>")), lambda r: F.struct(r.alias("range"), F.lit(extra).alias("extra")))
    copies = F.concat(F.array(F.struct("range", F.lit(0).alias("extra"))), own("before", 1), own("wrapped", 2))
    placed = placed.join(F.broadcast(heads), F.col("id").eqNullSafe(F.col("first_id")) & (F.col("hash") == F.col("first_hash")), "left")
    dealt = placed.withColumn("own", F.explode(copies)).select("id", "text", F.col("own.range").alias("range"), F.col("own.extra").alias("extra"), "hash", "weight")
    dealt = dealt.repartition(n, "range").sortWithinPartitions("range", "extra", F.desc_nulls_last("id"), "hash", F.desc("weight"))

    def run(batches):
        hashes = kept("hashes", _Hashes)
        waiting: list[tuple] = []  # (range, id, text, weight) whose next row is not known yet
        done: list[tuple] = []  # (id, text, next text, weight)
        closed = None  # the range whose last row has got its next
        size = 0

        def emit():
            texts = pa.array([d[1] for d in done], pa.string())
            nexts = pa.array([d[2] for d in done], pa.string())
            changed = [edited(d[1], d[2]) for d in done]
            own, after, other = (bytes_of(signatures(*shingles(x, hashes))) for x in (texts, nexts, pa.array(changed, pa.string())))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([d[0] for d in done], ids), pa.array([len(d[1]) for d in done], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
                    pa.array([x.tobytes().hex() for x in own]), pa.array([x.tobytes().hex() for x in other]), pa.array(likeness(own, other)), pa.array(likeness(own, after)), pa.array([d[3] for d in done], pa.int64()),
                ],
                names=[*names, "weight"],
            )

        for block in blocks(batches, 1):
            ids = block.column(0).type
            for key, text, range_, extra, weight in zip(*(block.column(k).to_pylist() for k in range(5)), strict=True):
                if waiting and waiting[0][0] == range_:
                    done.append((waiting[0][1], waiting[0][2], text, waiting[0][3]))
                    size += len(waiting[0][2])
                    waiting = []
                    if extra:
                        closed = range_
                if not extra and closed != range_:
                    waiting = [(range_, key, text, weight)]
                if size > 2_000_000:
                    yield emit()
                    done, size = [], 0
        if done:
            yield emit()

    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    out = arrow_map(dealt, ["id", "text", "range", "extra", "weight"], run, f"{id_col} {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, weight long")
    if repeats:  # a row for each that was folded, in two steps, so that no array is long
        out = out.withColumn("tens", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("weight") - 1) / OFTEN))))
        out = out.withColumn("ones", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(OFTEN).cast("long"), F.col("weight") - F.col("tens") * OFTEN))))
    return out.select(*names)


def _folded(rows: DataFrame, often: DataFrame) -> DataFrame:
    """The rows with two for each (``id``, ``hash``) of ``often``: the first stands for all but one."""
    same = rows["id"].eqNullSafe(often["id"]) & (rows["hash"] == often["hash"])
    marked = rows.join(often.select("id", "hash", "count"), same, "left").select(rows["id"], rows["text"], rows["hash"], rows["weight"], "count")
    few = marked.where("count is null").drop("count")
    one = marked.where("count is not null").groupBy("id", "hash").agg(F.min("text").alias("text"), F.first("count").alias("count"))
    two = one.withColumn("weight", F.explode(F.array(F.col("count") - 1, F.lit(1).cast("long"))))
    return few.unionByName(two.select("id", "text", "hash", "weight"))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, majority: Callable[[str], int] | None = None) -> DataFrame:
    """Per row: the id, ``digest`` of the text, ``fingerprint`` (binary), and ``bands``, a hash of each band of the full signature (null for a text without shingles); with ``majority`` also ``bits``, what it gives of the text."""

    def run(batches):
        import xxhash

        hashes = kept("hashes", _Hashes)
        for block in blocks(batches, 1, 2 << 20):
            h, at = shingles(block.column(1), hashes, width)
            full = signatures(h, at)
            band = np.ascontiguousarray(full.reshape(len(full), BANDS, -1).astype(np.uint64))
            key = np.tile(np.arange(BANDS, dtype=np.uint64), (len(full), 1))
            for k in range(band.shape[2]):
                key = (key ^ band[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(31)
            some = np.diff(at) > 0
            lists = pa.array([x if y else None for x, y in zip(key.view(np.int64), some.tolist(), strict=True)], pa.list_(pa.int64()))
            digests = [xxhash.xxh128_hexdigest(t.encode()) for t in block.column(1).to_pylist()]
            out = [block.column(0), pa.array(digests, pa.string()), pa.array([x.tobytes() for x in bytes_of(full)], pa.binary()), lists]
            if majority:
                out.append(pa.array(np.array([majority(t) for t in block.column(1).to_pylist()], dtype=np.uint64).view(np.int64)))
            yield pa.RecordBatch.from_arrays(out, names=names)

    names = [id_col, "digest", "fingerprint", "bands", *(["bits"] if majority else [])]
    return arrow_map(df, [id_col, text_col], run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, digest string, fingerprint binary, bands array<long>" + (", bits long" if majority else ""))


def forest(prints: np.ndarray, maybe: float) -> list[tuple[int, int]]:
    """Links (places) of a forest that connects what pairs of likeness ``maybe`` or more connect."""
    left, out = np.arange(len(prints)), []
    while len(left) > 1:
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            at = front.pop()
            near = likeness(prints[left], prints[at]) >= maybe
            own = left[near].tolist()
            out += [(at, x) for x in own]
            front += own
            left = left[~near]
    return out


def links(prints: DataFrame, least: float = LEAST) -> DataFrame:
    """Candidate links (``a``, ``b``) among rows (``node`` long, ``fingerprint``, ``bands``), one for each distinct text; they are read twice, so hand in a table or a checkpoint.

    Texts of one bucket whose likeness is within SLACK of ``least`` end up connected, whatever else the bucket holds. A large bucket
    is dealt into blocks of up to MOST texts, and each pair of its blocks is a task's work.
    """

    def search(batches):
        found: list[np.ndarray] = []
        held = None

        def runs(keys, nodes, own):
            starts = np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1))
            sizes = np.diff(np.append(starts, len(keys)))
            first = np.repeat(starts, sizes)
            like = likeness(own, own[first]) >= least - SLACK
            found.append(np.stack([nodes[first[like]], nodes[like]], axis=1))
            for k in np.flatnonzero(np.add.reduceat(like, starts, dtype=np.int64) < sizes).tolist():
                run = slice(starts[k], starts[k] + sizes[k])
                if pairs := forest(own[run], least - SLACK):
                    found.append(nodes[run][np.array(pairs)])

        def flush():
            ab = np.concatenate(found)
            found.clear()
            a, b = contract(ab[:, 0], ab[:, 1])
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            now = batch.column(0).to_numpy(), batch.column(1).to_numpy(), raw(batch.column(2))[0].reshape(-1, PERMUTATIONS)
            if held is not None:
                now = tuple(np.concatenate(x) for x in zip(held, now, strict=True))
            last = int(np.searchsorted(now[0], now[0][-1]))  # the last bucket may go on
            held = tuple(x[last:] for x in now)
            if last:
                runs(*(x[:last] for x in now))
            if sum(map(len, found)) > 200_000:
                yield flush()
        if held is not None:
            runs(*held)
            yield flush()

    prints = prints.where("bands is not null")
    bands = prints.select("node", F.explode("bands").alias("bucket"))
    sizes = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("parts", parts_of("n", MOST)).drop("n")
    shared = bands.join(sizes, "bucket")
    crowded = checkpointed(shared.where("parts > 1").join(prints.select("node", "fingerprint"), "node"))
    found, left = _pivoted(crowded, least) if not crowded.isEmpty() else ([], [])
    dealt = block_pairs(shared.where("parts = 1"), "bucket").select("node", "key").join(prints.select("node", "fingerprint"), "node").withColumn("side", F.lit(0))
    for more in left:
        dealt = dealt.unionByName(more)
    n = max(1, int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = dealt.repartition(n, "key").sortWithinPartitions("key", "side", "node")
    out = arrow_map(dealt, ["key", "node", "fingerprint"], search, "a long, b long")
    for more in found:
        out = out.unionByName(more)
    return out


def _pivoted(rows: DataFrame, least: float) -> tuple[list[DataFrame], list[DataFrame]]:
    """Links, and rows still to be compared by ``key``, of crowded buckets (``bucket``, ``node``, ``fingerprint``, ``parts``).

    A pass holds each bucket's rows against one of them, the pivot, a row once: those like it are linked to it, and are one candidate class. The number of
    bytes in which fingerprints differ is a metric, so of the others only those within twice the linking distance of the pivot, the ring, can be
    like a row that is like it: these two are compared block by block, but for rows that the pivot's distances keep apart. All others go on as a smaller bucket. A family of near copies is
    linked in one pass, with one copy of each row; what PIVOTS passes leave is compared in pairs of blocks.
    """
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    reach = _differing(least - SLACK)

    def against(batches):
        key, own = None, None
        for batch in batches:
            keys, nodes = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            prints = raw(batch.column(3))[0].reshape(-1, PERMUTATIONS)
            apart = np.zeros(len(keys), dtype=np.int32)
            starts = np.append(np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))[: len(keys)]), len(keys))
            for i, j in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if keys[i] != key:  # the pivot comes first
                    key, own = keys[i], prints[i].copy()
                apart[i:j] = (prints[i:j] != own).sum(axis=1)
            side = batch.column(1).to_numpy()
            keep = side == 1
            out = pa.RecordBatch.from_arrays([batch.column(4), pa.array(nodes), batch.column(3), batch.column(5), pa.array(apart)], names=["bucket", "node", "fingerprint", "pivot", "apart"])
            yield out.filter(pa.array(keep))

    found, left = [], []
    for _ in range(PIVOTS):
        pivots = rows.groupBy("bucket").agg(F.min("node").alias("pivot"))
        sided = rows.join(pivots, "bucket").withColumn("side", (F.col("node") != F.col("pivot")).cast("int"))
        part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
        sided = sided.withColumn("part", F.explode(F.when(F.col("side") == 0, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(part))))
        dealt = sided.select(F.xxhash64("bucket", "part").alias("key"), "side", "node", "fingerprint", "bucket", "pivot").repartition(n, "key").sortWithinPartitions("key", "side", "node")
        held = checkpointed(arrow_map(dealt, ["key", "side", "node", "fingerprint", "bucket", "pivot"], against, "bucket long, node long, fingerprint binary, pivot long, apart int"))
        near, rest = F.col("apart") <= reach, F.col("apart") > reach
        found.append(held.where(near).select(F.col("pivot").alias("a"), F.col("node").alias("b")))
        # a ring row at distance d can only be like rows that are d - reach or farther from the pivot
        closest = held.where(rest & (F.col("apart") <= 2 * reach)).groupBy("bucket").agg(F.min("apart").alias("closest"))
        farthest = held.where(near).groupBy("bucket").agg(F.max("apart").alias("farthest"))
        facing = held.join(closest.join(farthest, "bucket"), "bucket")
        facing = facing.where(near & (F.col("apart") >= F.col("closest") - reach) | rest & (F.col("apart") - reach <= F.col("farthest"))).withColumn("ring", rest.cast("int"))
        counts = facing.groupBy("bucket").agg(F.sum(1 - F.col("ring")).alias("near_n"), F.sum("ring").alias("ring_n")).where("near_n > 0 and ring_n > 0")
        counts = counts.select("bucket", parts_of("near_n", MOST).alias("near_parts"), parts_of("ring_n", MOST).alias("ring_parts"))
        facing = facing.join(counts, "bucket")
        own = F.pmod(F.xxhash64("node"), F.when(F.col("ring") == 1, F.col("ring_parts")).otherwise(F.col("near_parts"))).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.when(F.col("ring") == 1, F.col("near_parts")).otherwise(F.col("ring_parts")) - 1))
        facing = facing.withColumn("own", own).withColumn("other", other)
        a, b = F.when(F.col("ring") == 0, F.col("own")).otherwise(F.col("other")), F.when(F.col("ring") == 0, F.col("other")).otherwise(F.col("own"))
        left.append(facing.select("node", F.xxhash64(F.lit("ring"), "bucket", "pivot", a, b).alias("key"), "fingerprint", F.col("ring").alias("side")))
        settled = held.agg(F.avg(near.cast("int"))).first()[0] or 0.0
        others = held.where(rest).select("bucket", "node", "fingerprint")
        sizes = others.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("parts", parts_of("n", MOST)).drop("n")
        rows = checkpointed(others.join(sizes, "bucket"))
        done = rows.where("parts = 1")
        left.append(done.select("node", F.xxhash64(F.lit("rest"), "bucket", "parts").alias("key"), "fingerprint", F.lit(0).alias("side")))
        rows = rows.where("parts > 1")
        if settled < SETTLED or rows.isEmpty():
            break
    left.append(block_pairs(rows, "bucket").select("node", "key", "fingerprint", F.lit(0).alias("side")))
    return found, left


def _differing(like: float) -> int:
    """The most bytes in which fingerprints of a likeness may differ."""
    return int(math.floor(PERMUTATIONS * (1 - (like * (1 - 1 / 256) + 1 / 256)) + 1e-9))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """Per row: the id and ``class_id``, the least id of its near-duplicate class (null if no row of the class has an id).

    Equal texts are one text first, and so are all texts without shingles. Candidate classes come from the buckets of the bands; inside them, all pairs of texts
    count whose shingle sets have a Jaccard similarity of ``least`` or more.
    """
    from lodestone.llm import simhash  # its stage for near copies proposes by the bands of this module

    whole = simhash.keyed(df, id_col, text_col)
    classes, _, keys = simhash.text_classes(whole, SHINGLE, least)
    found = checkpointed(classes)
    smallest = found.groupBy("root").agg(F.min("least").alias("class_id"))
    named = found.select(F.col("text_key").alias("class_key"), "root").join(smallest, "root").select("class_key", "class_id")
    return keys.join(named, F.col("text_key") == F.col("class_key")).select(F.col("id").alias(id_col), "class_id")


def oracle() -> str:
    """DuckDB SQL for the rows of ``near_duplicates`` over ``documents``: all pairs of texts that share a shingle, and what they connect."""
    upper, lower = ("".join(chr(c + k) for k in range(26)) for c in (65, 97))
    return f"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
n AS (SELECT w, row_number() OVER () AS node, least_id FROM (SELECT w, min(doc_id) AS least_id FROM t GROUP BY w)),
s AS (SELECT DISTINCT node, unnest(CASE WHEN len(w) >= {SHINGLE} THEN list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: list_slice(w, i, i + {SHINGLE - 1})) WHEN len(w) > 0 THEN [w] ELSE [] END) AS shingle FROM n),
c AS (SELECT node, count(*) AS n FROM s GROUP BY node),
pairs AS (SELECT a.node AS a, b.node AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.node < b.node GROUP BY a.node, b.node),
e AS (SELECT a, b FROM pairs JOIN c x ON x.node = a JOIN c y ON y.node = b WHERE shared >= {LEAST} * (x.n + y.n - shared)),
sides AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reached(node, root) AS (SELECT node, node FROM n UNION SELECT b, root FROM reached JOIN sides ON a = node),
class AS (SELECT r.node, min(m.least_id) AS class_id FROM reached r JOIN n m ON m.node = r.root GROUP BY r.node)
SELECT doc_id, class_id FROM t JOIN n USING (w) JOIN class USING (node)"""
