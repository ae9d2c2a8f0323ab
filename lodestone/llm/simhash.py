"""SimHash near-duplicates by covering locality-sensitive hashing.

A text's fingerprint has a bit set where over half of its shingles' 64-bit hashes have it. Links
join fingerprints that differ in at most RADIUS bits. To find them, each bit position gets a non-zero vector of
RADIUS + 1 bits, and each non-zero vector v is a mask of the positions whose vectors have an odd
inner product with v. For any RADIUS positions some v is orthogonal to all their vectors, so the
mask of v leaves them out: every pair within the radius agrees on some mask, and meets in that table.

Equal fingerprints are one row first, so copies cost nothing more. A bucket of up to MOST fingerprints is searched as it
streams by in sorted order, and gives a forest of its links rather than all pairs. A larger bucket is
split by a covering of the bits that its key leaves open; with distinct fingerprints the open bits halve
at each level, so this ends and loses no pair.

Results in special cases: a null or empty text has no words and fingerprint 0, linked like any other; under three
words the whole sequence is the shingle; very long texts count whole; repeated rows each get their row; rows
without an id get the class of their fingerprint; an empty table gives an empty result; columns other than
the id and the text are never read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import minhash
from lodestone.llm._common import arrow_map, block_pairs, blocks, checkpointed, parts_of, ragged
from lodestone.llm.components import connected_components, contract

RADIUS = 3
BITS = 64
#: Fingerprints of a bucket that one task searches at once.
MOST = 4096


def shingle_hashes(text: str, width: int) -> list[int]:
    import xxhash

    digest = xxhash.xxh64_intdigest
    found = text.encode().lower().split()  # bytes: A-Z and ASCII white space only
    if len(found) <= width:
        return [digest(b" ".join(found), 42)] if found else []
    return [digest(b" ".join(s), 42) for s in zip(*(found[k:] for k in range(width)), strict=False)]


def majority(hashes: list[int]) -> int:
    """The bits set in over half of the hashes."""
    if not hashes:
        return 0
    octets = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    counts = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(octets), 4096):
        counts += np.unpackbits(octets[k : k + 4096], axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return int(np.packbits(2 * counts > len(octets), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """Per row: the id and ``bits``, the fingerprint as a long."""

    def run(batches):
        for block in blocks(batches, 1):
            bits = [majority(shingle_hashes(t, width)) for t in block.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(np.array(bits, dtype=np.uint64).view(np.int64))], names=[id_col, "bits"])

    return arrow_map(df, [id_col, text_col], run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, bits long")


def covering(radius: int, positions: list[int], bits: int = BITS) -> list[int]:
    """Masks over the positions such that any ``radius`` of them are left out by some mask."""
    size = 1 << (radius + 1)
    vector = {p: 1 + k % (size - 1) for k, p in enumerate(positions)}
    return [sum(1 << p for p in positions if (vector[p] & v).bit_count() & 1) for v in range(1, size)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(bits: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (places) of a forest that connects what links within the radius connect among distinct fingerprints."""
    bits = bits.view(np.uint64)
    if len(bits) == 2:
        return [(0, 1)] if int(bits[0] ^ bits[1]).bit_count() <= radius else []
    left, out = np.arange(len(bits)), []
    while len(left) > 1:
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            at = front.pop()
            near = np.bitwise_count(bits[left] ^ bits[at]) <= radius
            if near.any():
                own = left[near].tolist()
                out += [(at, x) for x in own]
                front += own
                left = left[~near]
    return out


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (``a``, ``b``) among rows (``node`` long, ``bits`` long, ``salt`` int): within each salt, nodes within the radius end up connected.

    Nodes with equal bits are chained as they stream by; distinct bits of a bucket are linked by a forest.
    """

    def search(batches):
        state = {"key": None, "covered": 0, "bits": [], "nodes": [], "size": 0, "last": None}
        links_: list[np.ndarray] = []

        def out(open_, bucket, cover, a, b):
            n = len(a)
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, open_)), pa.array(np.full(n, bucket, dtype=np.int64)), pa.array(np.full(n, cover, dtype=np.int64)), pa.array(a), pa.array(b)], names=["open", "bucket", "covered", "a", "b"])

        def finish():
            if 1 < state["size"] <= MOST:
                bits, nodes = np.concatenate(state["bits"]), np.concatenate(state["nodes"])
                pairs = forest(bits, radius)
                if pairs:
                    links_.append(nodes[np.array(pairs)])

        def flush():
            ab = np.concatenate(links_)
            links_.clear()
            return out(False, 0, 0, ab[:, 0].copy(), ab[:, 1].copy())

        for batch in batches:
            keys, covers, bits, nodes = (batch.column(k).to_numpy() for k in range(4))
            cuts = (np.flatnonzero(np.diff(keys)) + 1).tolist()
            for i, j in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if i == j:
                    continue
                if keys[i] != state["key"]:
                    finish()
                    state |= {"key": int(keys[i]), "covered": int(covers[i]), "bits": [], "nodes": [], "size": 0, "last": None}
                own, own_nodes = bits[i:j], nodes[i:j]
                before, before_node = state["last"] or (~own[0], own_nodes[0])
                state["last"] = (own[-1], own_nodes[-1])
                equal = own == np.concatenate(([before], own[:-1]))
                if equal.any():
                    links_.append(np.stack([np.concatenate(([before_node], own_nodes[:-1]))[equal], own_nodes[equal]], axis=1))
                state["bits"].append(own[~equal])
                state["nodes"].append(own_nodes[~equal])
                state["size"] += int((~equal).sum())
                if state["size"] > MOST:  # hand the bucket on
                    rows = np.concatenate(state["nodes"]), np.concatenate(state["bits"])
                    state |= {"bits": [], "nodes": []}
                    if len(rows[0]):
                        yield out(True, state["key"], state["covered"], *rows)
            if sum(map(len, links_)) > 100_000:
                yield flush()
        finish()
        if links_:
            yield flush()

    spark = prints.sparkSession
    masks = covering(radius, list(range(BITS)))
    rows = prints.select("node", "bits", F.col("salt").cast("long").alias("bucket"), F.lit(0).cast("long").alias("covered"), F.explode(F.array(*(F.lit(signed(m)) for m in masks))).alias("mask"))
    found = None
    while True:
        keyed = rows.select(F.xxhash64("mask", "bucket", F.col("bits").bitwiseAND(F.col("mask"))).alias("bucket"), F.col("covered").bitwiseOR(F.col("mask")).alias("covered"), "bits", "node")
        dealt = keyed.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "bucket").sortWithinPartitions("bucket", "bits", "node")
        out = checkpointed(arrow_map(dealt, ["bucket", "covered", "bits", "node"], search, "open boolean, bucket long, covered long, a long, b long"))
        edges = out.where(~F.col("open")).where("a != b").select("a", "b")
        found = edges if found is None else found.unionByName(edges)
        rest = out.where("open")
        covers = [r[0] for r in rest.select("covered").distinct().collect()]  # no more than the masks of a level
        if not covers:
            return found
        # the masks of the next level by what a key has covered: bits that are open halve, so there are at most three levels: 15 * 15 rows here, and 15 times as many at the last
        masks = [(c, signed(m)) for c in covers for m in covering(radius, [p for p in range(BITS) if not c >> p & 1])]
        level = spark.createDataFrame(masks, "covered long, mask long")
        rows = rest.select(F.col("a").alias("node"), F.col("b").alias("bits"), "bucket", "covered").join(F.broadcast(level), "covered")


def components(prints: DataFrame, id_col: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """Per row of (id, ``bits``): also ``component_id``, the smallest id that links reach."""
    prints = checkpointed(prints)
    distinct = checkpointed(prints.groupBy("bits").agg(F.min(id_col).alias("least")))
    roots = connected_components(links(distinct.select(F.col("bits").alias("node"), "bits", F.lit(0).alias("salt")), radius))
    rooted = distinct.join(roots, distinct["bits"] == roots["node"], "left").select("bits", "least", F.coalesce("root", "bits").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = checkpointed(rooted.join(smallest, "root").select(F.col("bits").alias("bits_"), "component_id"))
    return prints.join(classes, F.col("bits") == F.col("bits_"), "left").select(id_col, "bits", "component_id")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = RADIUS) -> DataFrame:
    """Per row: the id, ``fingerprint`` (16 hexadecimal digits) and ``component_id``."""
    found = components(fingerprints(df, id_col, text_col, width), id_col, radius)
    return found.select(id_col, F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


# Similar texts: covering masks over fingerprints propose, and bands of MinHash signatures beyond their radius; word shingles decide.

SHINGLE = 5
LEAST = 0.8
#: Documents and characters that one task compares with as many others at once, at most.
BLOCK_ROWS, BLOCK_CHARS = 1000, 4_000_000
#: Times that classes beyond one block are held against one of their documents before their blocks are compared, and the share of rows that a pass must settle to be worth another.
PIVOTS, SETTLED = 4, 0.1


def shingle_set(text: str, width: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, width), dtype=np.uint64))


def similar(sets: list[np.ndarray], least: float, sides: list[int]) -> list[tuple[int, int]]:
    """Places of all pairs of sets with Jaccard similarity ``least`` or more; with sides 0 and 1, only pairs across."""
    sizes = np.array([len(s) for s in sets])
    if len(sets) == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if both and both >= least * (sizes.sum() - both) else []
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, shingle = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(shingle, kind="stable")
    posting = owner[order]
    ends = np.cumsum(np.bincount(shingle))
    starts = np.concatenate(([0], ends[:-1]))
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    side = np.array(sides)
    mixed = side.min() != side.max()
    out = []
    for i in range(len(sets)):
        own = shingle[bounds[i] : bounds[i + 1]]
        shared = np.bincount(posting[ragged(starts[own], ends[own] - starts[own])], minlength=len(sets))
        near = (shared > 0) & (shared >= least * (sizes[i] + sizes - shared)) & (np.arange(len(sets)) > i)
        if mixed:
            near &= side != side[i]
        out += [(i, int(j)) for j in np.flatnonzero(near)]
    return out


def _parts(rows: str, chars: str):
    """Blocks of a class from its numbers of rows and characters."""
    return F.greatest(parts_of(rows, BLOCK_ROWS), F.ceil(F.col(chars) / BLOCK_CHARS)).cast("int")


def _sized(rows: DataFrame) -> DataFrame:
    """The rows with ``parts``, the blocks of their class."""
    sizes = rows.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    return rows.join(sizes.select("root", _parts("n", "chars").alias("parts")), "root")


def _compared(dealt: DataFrame, width: int, least: float) -> DataFrame:
    """Links (``a``, ``b``) that connect what is similar among rows (``node``, ``side``, ``text``) of one ``key``; where a key has both sides, only pairs across count."""

    def search(batches):
        held: list[tuple[int, int, str]] = []
        key = None

        def finish():
            if len(held) < 2:
                return None
            sides = [h[1] for h in held]
            pairs = similar([shingle_set(h[2], width) for h in held], least, sides)
            if not pairs:
                return None
            ids = np.array([h[0] for h in held], dtype=np.int64)
            at = np.array(pairs)
            a, b = contract(ids[at[:, 0]], ids[at[:, 1]])
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for block in blocks(batches, 3):
            for k, node, side, text in zip(*(block.column(i).to_pylist() for i in range(4)), strict=True):
                if k != key:
                    if (got := finish()) is not None:
                        yield got
                    held, key = [], k
                held.append((node, side, text))
        if (got := finish()) is not None:
            yield got

    n = max(1, int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # by ranges, which even out what keys weigh: a few hundred heavy ones would not spread by hash
    dealt = dealt.select("key", "node", "side", "text").repartitionByRange(n, "key").sortWithinPartitions("key", "side", "node")
    return arrow_map(dealt, ["key", "node", "side", "text"], search, "a long, b long")


def _held_against(rows: DataFrame, width: int, least: float) -> DataFrame:
    """The rows (``node``, ``text``, ``root``, ``parts``) with ``pivot``, the least node of their class, and ``like``: 2 if similar to it, 1 if something similar to it may be similar to them, else 0; -1 for the pivot itself.

    Jaccard distance is a metric: what is similar to a row that is similar to the pivot is within twice the distance of the pivot.
    """

    def search(batches):
        key, own = None, None
        for block in blocks(batches, 3):
            out = []
            for k, side, node, text in zip(*(block.column(i).to_pylist() for i in range(4)), strict=True):
                found = shingle_set(text, width)
                if k != key:  # the pivot comes first
                    key, own = k, found
                if not side:
                    out.append(-1)
                    continue
                both = len(np.intersect1d(own, found, assume_unique=True))
                every = len(own) + len(found) - both
                out.append(2 if both >= least * every else int(both >= (2 * least - 1 - 1e-9) * every))
            yield pa.RecordBatch.from_arrays([block.column(2), block.column(3), block.column(4), block.column(5), pa.array(out, pa.int32())], names=["node", "text", "root", "pivot", "like"])

    small = 2 * F.col("parts")  # tasks of this pass hold one block's half at most, and copies of the pivot are all that it moves besides
    pivots = rows.groupBy("root").agg(F.min("node").alias("pivot"))
    own = F.pmod(F.xxhash64("node"), small).cast("int")
    dealt = rows.join(pivots, "root").withColumn("side", (F.col("node") != F.col("pivot")).cast("int"))
    dealt = dealt.withColumn("part", F.explode(F.when(F.col("side") == 0, F.sequence(F.lit(0), (small - 1).cast("int"))).otherwise(F.array(own))))
    dealt = dealt.select(F.xxhash64("root", "part").alias("key"), "side", "node", "text", "root", "pivot")
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = dealt.repartition(n, "key").sortWithinPartitions("key", "side", "node")
    return arrow_map(dealt, ["key", "side", "node", "text", "root", "pivot"], search, "node long, text string, root long, pivot long, like int")


def _across(held: DataFrame) -> DataFrame:
    """Rows similar to a pivot (side 1) beside those that may be similar to such a row (side 0), for ``_compared``: each pair of their blocks is a key."""
    of = lambda like, name: held.where(F.col("like") == like).groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")).select("root", _parts("n", "chars").alias(name))
    sizes = of(2, "near").join(of(1, "ring"), "root")
    rows = held.where(F.col("like") > 0).join(sizes, "root").withColumn("side", F.col("like") - 1)
    own = F.pmod(F.xxhash64("node"), F.when(F.col("side") == 1, F.col("near")).otherwise(F.col("ring"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("side") == 1, F.col("ring")).otherwise(F.col("near")) - 1))
    rows = rows.withColumn("own", own).withColumn("other", other)
    low, high = F.when(F.col("side") == 1, F.col("own")).otherwise(F.col("other")), F.when(F.col("side") == 1, F.col("other")).otherwise(F.col("own"))
    return rows.select(F.xxhash64(F.lit("across"), "pivot", low, high).alias("key"), "node", "side", "text")


def similar_links(df: DataFrame, classes: DataFrame, id_col: str, text_col: str, width: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """Links (``a``, ``b``) that connect those rows of one candidate class (``node``, ``root``) whose shingle sets are similar.

    A class of one block is one task's work. A larger one is first held against one of its rows, the pivot, which takes one
    pass over the class: what is similar to the pivot is one group and needs no comparison with each other, only with the rows that
    the triangle inequality leaves. The others go on as a smaller class. What PIVOTS such passes leave over one block is dealt into
    blocks, and each pair of them is a task's work. So a large group of copies costs a few passes, memory is bounded, and no pair is lost.
    """
    rows = df.select(F.col(id_col).alias("node"), F.col(text_col).alias("text")).join(classes, "node")
    rows = checkpointed(_sized(rows))
    found, dealt, ready = [], [], [rows.where("parts = 1")]
    for _ in range(PIVOTS):
        rows = rows.where("parts > 1")
        if rows.isEmpty():
            break
        held = checkpointed(_held_against(rows, width, least))
        settled = held.agg(F.avg((F.col("like") == 2).cast("int"))).first()[0]
        found.append(held.where("like = 2").select(F.col("pivot").alias("a"), F.col("node").alias("b")))
        dealt.append(_across(held))
        rows = checkpointed(_sized(held.where("like in (0, 1)").select("node", "text", "root")))
        if settled < SETTLED:
            break
        ready.append(rows.where("parts = 1"))
    else:
        rows = rows.where("parts > 1")
    ready.append(rows)  # what the passes left
    # a class has one part after one pass only, or is left over after the last
    whole = reduce(DataFrame.unionByName, (r.select("node", "text", "root", "parts") for r in ready))
    dealt.append(block_pairs(whole, "root").select("key", "node", "side", "text"))
    return reduce(DataFrame.unionByName, [_compared(reduce(DataFrame.unionByName, dealt), width, least), *found])


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows as ``row`` (all their columns), ``own`` (``id`` and ``text_key``, which texts without a word share) and ``text``.

    A caller's columns stay in one struct, so that none of them meets the names used here.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.when(text.rlike(r"[^\x09-\x0D ]"), F.sha2(text, 256)).otherwise(F.lit(""))
    return df.select(F.struct(*df.columns).alias("row"), F.struct(F.col(id_col).alias("id"), key.alias("text_key")).alias("own"), text.alias("text"))


def text_classes(whole: DataFrame, width: int = SHINGLE, least: float = LEAST, covered: bool = False) -> tuple[DataFrame, bool, DataFrame]:
    """Per distinct text of ``keyed`` rows: ``text_key``, ``least`` (its smallest id), ``node``, and ``root``, which similar texts share; whether rows repeat an id and a text; and
    each row's ``id`` and ``text_key``, from a checkpoint, for which no text is read again.

    Candidates are texts that MinHash bands bring together, and with ``covered`` also those whose fingerprints over the same shingles are within RADIUS, found by the covering masks.
    """
    found = checkpointed(minhash.fingerprints(whole, "own", "text", width, (lambda t: majority(shingle_hashes(t, width))) if covered else None).drop("digest").select("own.*", "fingerprint", "bands", *(["bits"] if covered else [])))
    repeats = not found.groupBy("id", "text_key").count().where("count > 1").isEmpty()
    first = found.groupBy("text_key").agg(F.min("id").alias("least"), F.first("fingerprint").alias("fingerprint"), F.first("bands").alias("bands"), *([F.first("bits").alias("bits")] if covered else []))
    first = checkpointed(first.withColumn("node", F.monotonically_increasing_id()))
    proposed = minhash.links(first, least)
    if covered:
        proposed = proposed.unionByName(links(first.where("bands is not null").select("node", "bits", F.lit(0).alias("salt"))))
    classes = checkpointed(connected_components(proposed))
    wanted = first.select("node", "text_key", "least").join(classes.select("node"), "node")
    texts = whole.select("own", "text").join(wanted, (F.col("own.text_key") == F.col("text_key")) & F.col("own.id").eqNullSafe(F.col("least"))).select("node", "text")
    roots = connected_components(similar_links(texts.dropDuplicates(["node"]) if repeats else texts, classes, "node", "text", width, least))
    return first.select("node", "text_key", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), repeats, found.select("id", "text_key")


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """The rows of ``df`` without near copies: of each group of texts linked by similarity, the row with the smallest id stays.

    Equal texts are one text first, and so are all texts without a word (nulls count as empty). Fingerprints within RADIUS bits, found by covering masks, and
    buckets of MinHash bands over the same word shingles, for what lies beyond, propose classes; inside them, links are the pairs whose sets of ``width``-word shingles have a Jaccard similarity of ``least``
    or more. Rows without an id are compared like any other, and stay only where their group has no id; of rows that repeat an id and a text one stays.
    """
    whole = keyed(df, id_col, text_col)
    found, repeats, _ = text_classes(whole, width, least, covered=True)
    order = F.struct(F.col("least").isNull(), "least", "node")
    stay = checkpointed(found.groupBy("root").agg(F.min_by(F.struct("text_key", "least"), order).alias("stay")).select("stay.*"))
    kept = whole.select("row", "own").join(stay, (F.col("own.text_key") == F.col("text_key")) & F.col("own.id").eqNullSafe(F.col("least")), "left_semi")
    return (kept.dropDuplicates(["own"]) if repeats else kept).select("row.*")
