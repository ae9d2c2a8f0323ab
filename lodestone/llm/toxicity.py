"""Toxicity by a weighted lexicon.

Texts are folded: lower case, without accents, look-alike letters of other alphabets and digits standing for letters become the
Latin letters meant, and so do signs between letters. An Aho-Corasick automaton over the folded lexicon and the exception phrases finds
all whole-word hits in one scan; a hit inside an exception phrase does not count, whatever white space, line ends or hyphens
stand between the phrase's words. The hits' weights
are normalised by the text's length and put through a logistic curve.

The lexicon is the seed terms and the words that the labelled sample shows to be toxic. A word's support
is its number of different left neighbours, so that copies of one text count once. Weights are smoothed log
odds; a word enters if a lower bound of its weight is over ENTER. The sample is bounded: one text for each of the SAMPLE labelled ids with the
lowest hash, as many as SAMPLE_BYTES hold. All words that enter are terms: the sample's bytes bound them, as each stands there SUPPORT times at the least.

Results in special cases: a null or empty text has no hits and scores the curve at no evidence; very long texts are scanned
whole; repeated rows each get their row; null ids and null labels are not learnt from; without labels the seeds
have their default weight and curve; an empty table gives an empty result; columns other than those named are not read.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import arrow_map, blocks, crc_of_id, kept
from lodestone.llm.quality_classifier import SAMPLE, SAMPLE_BYTES, sample_texts

SEEDS = ["clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless"]
SEED_WEIGHT = 3.0
EXCEPTIONS = ["class clown", "clown fish", "pond scum", "soap scum", "trash bag", "trash bin", "trash can", "winner and loser", "worthless check"]

#: Different left neighbours in toxic texts that a learnt word needs.
SUPPORT = 6
ENTER = 1.5

#: Letters that look like others: Cyrillic, Greek and full-width forms. Capitals that look otherwise than their small letters come first.
CAPITALS = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "abezhikmnoptyx", strict=True))
LOOKS = dict(zip("авеѕіјкмнорстухһԁԛԝɡαβεζηικμνορτυχω", "abesijkmhopctyxhdqwgabeznikuvoptuxw", strict=True)) | {chr(0xFF41 + k): chr(97 + k) for k in range(26)} | {chr(0xFF10 + k): chr(48 + k) for k in range(10)}
#: Digits that stand for letters.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}
#: Signs that stand for letters between letters.
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i"}
_HIDDEN = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, *range(0x300, 0x370)])


def _bases() -> dict[str, str]:
    """Small Latin letters with accents, and their letters without."""
    found = ((chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)])
    return {c: base for c, base in found if c == c.lower() and c != base and base.isascii()}


_BASES = _bases()
_TABLE = {ord(a): b for a, b in _BASES.items()} | {ord(a): DIGITS.get(b, b) for a, b in LOOKS.items()} | {ord(a): b for a, b in DIGITS.items()} | _HIDDEN
_CAPITALS, _ANY_CAPITAL = str.maketrans(CAPITALS), re.compile("[" + "".join(CAPITALS) + "]")
_LATIN = bytes(ord(_BASES.get(c, DIGITS.get(c, c))) if len(c := chr(b).lower()) == 1 and ord(c) < 256 else b for b in range(256))
_SIGN = re.compile(r"(?<=[^\W\d_])[@$!|](?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")
#: What may part the words of a phrase.
_GAP = re.compile("[\\s\u2010-\u2015-]+")


def fold(text: str) -> str:
    """The text with its disguises undone."""
    try:
        text = text.encode("latin-1").translate(_LATIN, b"\xad").decode("latin-1")
    except UnicodeEncodeError:
        text = (text.translate(_CAPITALS) if _ANY_CAPITAL.search(text) else text).lower().translate(_TABLE)
    return _SIGN.sub(lambda m: SIGNS[m[0]], text) if "@" in text or "$" in text or "!" in text or "|" in text else text


def automaton(lexicon: dict[str, float], exceptions: list[str] = EXCEPTIONS):
    import ahocorasick

    out = ahocorasick.Automaton()
    for phrase in exceptions:
        out.add_word(fold(phrase), (len(fold(phrase)), None))
    for term, weight in lexicon.items():
        out.add_word(term, (len(term), weight))
    out.make_automaton()
    return out


def evidence(found, folded: str) -> float:
    """The weights of the whole-word hits outside exception phrases.

    Terms are words, so gaps only matter where there is a hit: such a text is swept again with each run of white space or hyphens as one space.
    """
    if not _hits(found, folded)[0]:
        return 0.0
    hits, spared = _hits(found, _GAP.sub(" ", folded))
    if spared:
        # a hit is spared if a phrase that ends no earlier starts no later: the least start of the phrases from each on
        ends, least = [b for _, b in spared], [a for a, _ in spared]
        for k in range(len(least) - 2, -1, -1):
            least[k] = min(least[k], least[k + 1])
        hits = [h for h in hits if (k := bisect_left(ends, h[1])) == len(ends) or least[k] > h[0]]
    return sum(h[2] for h in hits)


def _hits(found, folded: str) -> tuple[list[tuple[int, int, float]], list[tuple[int, int]]]:
    """Whole-word hits and exception phrases in one sweep, each in the order of their ends."""
    hits, spared = [], []
    last = len(folded) - 1
    for end, (length, weight) in found.iter(folded):
        start = end - length + 1
        if (start and folded[start - 1].isalnum()) or (end < last and folded[end + 1].isalnum()):
            continue
        if weight is None:
            spared.append((start, end))
        else:
            hits.append((start, end, weight))
    return hits, spared


def shape(total: float, n_words: int) -> list[float]:
    """What the logistic curve sees: evidence for its length, and whether there is any."""
    return [1.0, math.log1p(10 * total / math.sqrt(n_words + 10)), float(total > 0)]


def fit(rows: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> list[float]:
    """Logistic regression by Newton steps, with a small ridge."""
    w = np.array([-3.0, 1.0, 1.0])
    prior = w.copy()
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -35, 35)))
        h = (rows * (p * (1 - p))[:, None]).T @ rows + ridge * np.eye(3)
        w = w - np.linalg.solve(h, rows.T @ (p - y) + ridge * (w - prior))
    return w.tolist()


def learn(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> tuple[dict[str, float], list[float]]:
    """The lexicon with its weights, and the curve, from at most ``sample`` labelled ids of ``labels`` (id, label 0 or 1), whose texts have at most ``sample_bytes``."""
    rows = sample_texts(df, labels, id_col, text_col, label_col, sample, sample_bytes)

    def pairs(batches):
        for block in blocks(batches, 1):
            out = []
            for text, label in zip(block.column(1).to_pylist(), block.column(2).to_pylist(), strict=True):
                found = _WORD.findall(fold(text))
                out += [(w, left, label) for left, w in set(zip(["", *found[:-1]], found, strict=True))]
            words_, lefts, marks = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(words_, pa.string()), pa.array(lefts, pa.string()), pa.array(marks, pa.int32())], names=["word", "before", "label"])

    sizes = {int(r[0] > 0): r[1] for r in rows.select((F.col("label") > 0).cast("int").alias("label")).groupBy("label").count().collect()}
    bad_all, good_all = sizes.get(1, 0), sizes.get(0, 0)
    counted = arrow_map(rows, ["labelled", "text", "label"], pairs, "word string, before string, label int").distinct()
    bad, good = F.sum(F.when(F.col("label") > 0, 1).otherwise(0)), F.sum(F.when(F.col("label") > 0, 0).otherwise(1))
    weight = F.log((F.col("bad") + 0.5) / (bad_all + 1)) - F.log((F.col("good") + 0.5) / (good_all + 1))
    known = counted.groupBy("word").agg(bad.alias("bad"), good.alias("good")).withColumn("weight", weight)
    sure = F.col("weight") - 2 * F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    top = known.where(((F.col("bad") >= SUPPORT) & (sure > ENTER) & (F.length("word") > 2)) | F.col("word").isin(SEEDS)).orderBy(F.desc("weight"), "word").collect()  # bounded by the sample
    lexicon = dict.fromkeys(SEEDS, SEED_WEIGHT) | {r["word"]: r["weight"] for r in top}
    lexicon = {w: x for w, x in lexicon.items() if x > 0}
    totals = sums(rows, lexicon, "labelled", "text", ["label"]).select("label", "total", "n_words").collect() if bad_all and good_all else []  # one row for each id of the sample
    curve = fit(np.array([shape(r[1], r[2]) for r in totals]), np.array([float(r[0] > 0) for r in totals])) if totals else [-3.0, 1.0, 1.0]
    return lexicon, curve


def sums(df: DataFrame, lexicon: dict[str, float], id_col: str, text_col: str, more: list[str] = ()) -> DataFrame:
    """Per row: the id, further columns, ``total`` evidence and ``n_words``."""

    def run(batches):
        found = kept(f"lexicon {hash(tuple(sorted(lexicon.items())))}", lambda: automaton(lexicon))
        for block in blocks(batches, 1):
            folded = [fold(t) for t in block.column(1).to_pylist()]
            total = pa.array([float(evidence(found, t)) for t in folded], pa.float64())
            n = pa.array([len(t.split()) for t in folded], pa.int64())
            yield pa.RecordBatch.from_arrays([block.column(0), *(block.column(2 + k) for k in range(len(more))), total, n], names=[id_col, *more, "total", "n_words"])

    fields = [f"{c} {df.schema[c].dataType.simpleString()}" for c in (id_col, *more)]
    return arrow_map(df, [id_col, text_col, *more], run, ", ".join([*fields, "total double", "n_words long"]))


def score(df: DataFrame, lexicon: dict[str, float], curve: list[float], id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """Per row: the id, ``score`` (chance of label 1), ``predicted`` (1 if it is ``threshold`` or more), ``total`` and ``n_words``."""
    a, b, c = curve
    z = a + b * F.log1p(10 * F.col("total") / F.sqrt(F.col("n_words") + 10)) + c * (F.col("total") > 0).cast("double")
    scored = sums(df, lexicon, id_col, text_col).withColumn("score", 1 / (1 + F.exp(-z)))
    return scored.select(id_col, "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "total", "n_words")


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of all rows, learnt from the labels whose crc32 of the id is not 2 mod 4; ``held_out`` marks the others."""
    lexicon, curve = learn(df, labels.where(crc_of_id(id_col) % 4 != 2), id_col, text_col)
    held = F.coalesce(crc_of_id(id_col) % 4 == 2, F.lit(False)).alias("held_out")
    return score(df, lexicon, curve, id_col, text_col).select(id_col, held, "score", "predicted")


def top_terms(lexicon: dict[str, float], n: int = 20) -> list[str]:
    """The heaviest terms, for reports."""
    return [w for w, _ in Counter(lexicon).most_common(n)]
