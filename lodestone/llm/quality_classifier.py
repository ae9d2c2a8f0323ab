"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

A text's words are cut into runs of letters, digits and signs, and letters' shape is kept, so that shouting
and sign noise are words of their own. Unigrams and bigrams (a word that repeats the one before
gives the bigram "same", and "again" after that) are hashed to 2**BITS slots, valued by their count for each token of the text.
FTRL-Proximal learns on a bounded sample: the SAMPLE labelled ids with the lowest hash, one text for each, as long as their
texts have SAMPLE_BYTES together (a text that would go beyond is passed over). Features of the sample are made in parallel; one task, which these bounds
make small, learns from them, and only the weights reach the driver.
Every whole text is scored as a sparse dot product.

Results in special cases: a null or empty text has no features and scores the bias; very long texts count
whole; repeated rows each get their row; null ids and null labels are not learnt from; without labels the
score is 0.5; an empty table gives an empty result; columns other than those named are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import arrow_map, blocks, checkpointed, crc_of_id, kept, ragged, words

BITS = 18
#: Labelled ids learnt from, and the bytes of their texts, at most.
SAMPLE, SAMPLE_BYTES = 8000, 64 << 20
EPOCHS = 4
#: FTRL-Proximal: learning rate, its smoothing, and the penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.5

_RUNS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
_REPEATED = re.compile(r"(.)\1+", re.DOTALL)


def _hash(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text, 7)


def tokens_of(word: str) -> list[int]:
    """Hashes of a white-space word's runs: letters by themselves (capitals kept as a shape), signs with repeats of one as one mark."""
    out = []
    for run in _RUNS.findall(word):
        if run.isalpha():
            shape = "A" if run.isupper() and len(run) > 1 else "a"
            out.append(_hash(f"{shape}{run.lower()}"))
            if shape == "A":
                out.append(_hash("\0shout"))
        elif run.isdigit():
            out.append(_hash("\0digits"))
        else:
            out.append(_hash("\0" + _REPEATED.sub(r"\1+", run)))
    return out or [_hash("\0other")]


#: The pair of a repeated token, and of one repeated again.
SAME, AGAIN = np.uint64(0x1357_9BDF_0246_8ACE), np.uint64(0x7531_FDB9_8642_0ECA)
#: A value is this times the n-gram's count for each token.
SCALE = 20.0


class Featuriser:
    """Hashed n-gram slots of texts; token hashes of words already seen are kept, up to a bound."""

    MOST = 100_000

    def __init__(self):
        self.seen: dict[str, list[int]] = {}

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Slot and text of each n-gram, and each text's number of tokens (1 at least)."""
        codes, at, distinct = words(texts)
        seen = self.seen
        if len(seen) > self.MOST:
            seen.clear()
        lists = []
        for w in distinct.to_pylist():
            got = seen.get(w)
            if got is None:
                got = tokens_of(w)
                if len(w) < 64:
                    seen[w] = got
            lists.append(got)
        sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        flat = np.array([h for x in lists for h in x], dtype=np.uint64)
        starts = np.cumsum(sizes) - sizes
        tokens = flat[ragged(starts[codes], sizes[codes])] if len(codes) else np.zeros(0, dtype=np.uint64)
        at = np.concatenate(([0], np.cumsum(sizes[codes])))[at] if len(codes) else at
        owner = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))
        pair = tokens[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ tokens[1:]
        pair *= np.uint64(0xC4CEB9FE1A85EC53)
        same = tokens[:-1] == tokens[1:]
        pair[same] = SAME
        pair[1:][same[1:] & same[:-1]] = AGAIN
        inside = owner[1:] == owner[:-1]
        slots = (np.concatenate([tokens, pair[inside]]) >> np.uint64(64 - BITS)).astype(np.int32)
        return slots, np.concatenate([owner, owner[1:][inside]]), np.maximum(np.diff(at), 1)


def per_text(slots: np.ndarray, owner: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's distinct slots, their values, and the texts' offsets."""
    key, count = np.unique(owner.astype(np.int64) << BITS | slots, return_counts=True)
    owner = key >> BITS
    offsets = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(sizes)))))
    return key & ((1 << BITS) - 1), SCALE * count / sizes[owner], offsets


def learn(slots: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS) -> np.ndarray:
    """Weights of the slots, and the bias behind them, by per-coordinate FTRL-Proximal; rows in a fixed shuffled order."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)
    order = np.random.default_rng(11)

    def weight(at):
        own = z[at]
        return np.where(np.abs(own) <= L1, 0.0, -(own - np.sign(own) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(epochs):
        for i in order.permutation(len(labels)):
            at, x = np.append(slots[i], size - 1), np.append(values[i], 1.0)
            w = weight(at)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - labels[i]) * x
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - step * w
            n[at] += g * g
    return weight(np.arange(size))


def sample_of(labels: DataFrame, id_col: str, label_col: str, most: int) -> DataFrame:
    """At most ``most`` labelled rows, those with the lowest hash of their id; the bound makes them fit for a broadcast."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("labelled")).agg(F.max(label_col).cast("int").alias("label"))
    return checkpointed(known.orderBy(F.xxhash64("labelled"), "labelled").limit(most))


def sample_texts(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int, most_bytes: int) -> DataFrame:
    """At most ``most`` rows (``labelled``, ``label``, ``text``): one text for each id of ``sample_of``, as many as ``most_bytes`` hold, in the order of their hash.

    Of an id's texts the one with the lowest hash counts; nulls count as empty.
    """
    chosen = sample_of(labels, id_col, label_col, most)
    rows = df.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), F.col(id_col) == F.col("labelled"))
    one = rows.groupBy("labelled", "label").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("own"))
    one = checkpointed(one.select("labelled", "label", "own.text"))
    sizes = one.select("labelled", F.xxhash64("labelled").alias("hash"), F.octet_length("text").alias("bytes")).collect()  # ``most`` numbers
    kept_, total = [], 0
    for r in sorted(sizes, key=lambda r: (r["hash"], r["labelled"])):
        if total + r["bytes"] <= most_bytes:
            kept_.append((r["labelled"],))
            total += r["bytes"]
    if len(kept_) == len(sizes):
        return one
    return one.join(F.broadcast(one.sparkSession.createDataFrame(kept_, f"labelled {one.schema['labelled'].dataType.simpleString()}")), "labelled", "left_semi")


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> np.ndarray:
    """Weights learnt from at most ``sample`` labelled ids of ``labels`` (id, label 0 or 1), whose texts have at most ``sample_bytes``."""
    rows = sample_texts(df, labels, id_col, text_col, label_col, sample, sample_bytes)

    def features(batches):
        make = kept("featuriser", Featuriser)
        for block in blocks(batches, 1):
            slots, values, at = per_text(*make(block.column(1)))
            lists = lambda x, at=at: pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(x))
            yield pa.RecordBatch.from_arrays([block.column(0).cast(pa.string()), block.column(2), lists(slots.astype(np.int32)), lists(values.astype(np.float32))], names=["id", "label", "slots", "values"])

    def fit(batches):
        ids, labels_, slots, values = [], [], [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            labels_ += batch.column(1).to_pylist()
            slots += [np.asarray(x.values) for x in batch.column(2)]
            values += [np.asarray(x.values, dtype=np.float64) for x in batch.column(3)]
        order = sorted(range(len(ids)), key=ids.__getitem__)
        if order:
            y = np.array([labels_[i] for i in order], dtype=float)
            w = learn([slots[i] for i in order], [values[i] for i in order], y)
            yield pa.RecordBatch.from_arrays([pa.array([w.astype("<f8").tobytes()])], names=["weights"])

    made = arrow_map(rows, ["labelled", "text", "label"], features, "id string, label int, slots array<int>, values array<float>")
    got = arrow_map(checkpointed(made).repartition(1), ["*"], fit, "weights binary").collect()
    return np.frombuffer(bytes(got[0][0]), dtype="<f8") if got else np.zeros((1 << BITS) + 1)


def score(df: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """Per row: the id, ``score`` (chance of label 1) and ``predicted`` (1 if it is ``threshold`` or more)."""
    shared = df.sparkSession.sparkContext.broadcast(weights)  # of fixed size

    def run(batches):
        make, w = kept("featuriser", Featuriser), shared.value
        for block in blocks(batches, 1):
            slots, owner, sizes = make(block.column(1))
            z = SCALE * np.bincount(owner, weights=w[slots], minlength=block.num_rows) / sizes + w[-1]
            p = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[id_col, "score", "predicted"])

    return arrow_map(df, [id_col, text_col], run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, score double, predicted int")


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of all rows, learnt from the labels whose crc32 of the id is not 0 mod 5; ``held_out`` marks the others."""
    weights = train(df, labels.where(crc_of_id(id_col) % 5 != 0), id_col, text_col)
    return score(df, weights, id_col, text_col).select(id_col, F.coalesce(crc_of_id(id_col) % 5 == 0, F.lit(False)).alias("held_out"), "score", "predicted")
