"""Alignment of two tokenizers over the same bytes.

Both sides code space + text: A is a byte-level file of the tokenizers library, B a sentencepiece file, which adds the space itself.
A whole Arrow block is one run of bytes: the token lengths of all its documents are summed once for each side, the ends
are counted by bincount, and the bytes are cut where both sides end a token. Prefix sums over the block, read at the
documents' byte offsets, give each document's numbers.

A link is a pair of an A and a B token that end together. As both code the same bytes, one of the two is a suffix of the other, so
the pairs that can occur follow from the two vocabularies: no token has more of them than it has suffixes, which
bounds the table of corpus-wide counts whatever the corpus is (324,302 pairs for the given files). That table is what is sent
to the workers. Texts are coded once; their links are kept as Parquet in the shared folder between counting and looking counts up.

Results in special cases: a text that is null or empty, or whose joined tokens on either side are not space + text
(such as one with U+2581), has no tokens, zeros and an empty digest; special strings in a text are plain text; very long texts are
coded whole, and a block holds at least one; repeated rows each get their row and count each; a null id stays null; an
empty table gives an empty result; columns other than the id and the text are never read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import arrow_map, blocks, kept
from lodestone.llm._vocab import _RUN, CHAR_BYTE, CodeBook, file_path
from lodestone.shared import shared_folder

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"

#: The id that stands for a chunk whose tokens don't join to its bytes, and where a cached chunk's B ids begin.
BROKEN, SECOND = -1, 1 << 20
#: Text of a block: its arrays have some 150 times as many bytes for a moment.
BLOCK = 1 << 20
#: Sentencepiece's mark of a space.
MARK = "▁"


class Side:
    """One tokenizer: the bytes of its tokens, and the ids of space + text for many texts without that space."""

    def __init__(self, file: str):
        if file.endswith(".json"):
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(file_path(file))
            library.encode_special_tokens = True
            library.no_truncation()
            library.no_padding()
            own = library.get_vocab(with_added_tokens=True)
            self.token = [b""] * (max(own.values()) + 1)
            for t, i in own.items():
                self.token[i] = bytes(CHAR_BYTE[c] for c in t) if all(c in CHAR_BYTE for c in t) else t.encode()
            self.coded: Callable[[list[str]], list[list[int]]] = lambda texts: [e.ids for e in library.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
            self.chunked = library.normalizer is None
        else:
            import sentencepiece

            library = sentencepiece.SentencePieceProcessor(model_file=file_path(file))
            pieces = [library.id_to_piece(i) for i in range(library.get_piece_size())]
            byte = re.compile("<0x([0-9A-F]{2})>")
            self.token = [bytes([int(m[1], 16)]) if (m := byte.fullmatch(p)) else p.replace(MARK, " ").encode() for p in pieces]
            self.coded = lambda texts: library.encode(texts, num_threads=1)
            # a chunk starts at a space: only runs of spaces may hold one further on
            self.chunked = all(set(p) == {MARK} for p in pieces if MARK in p[1:])
        self.lengths = np.array([len(t) for t in self.token], dtype=np.int64)
        if not self.lengths.all():
            raise ValueError(f"{file} has a token without bytes")

    def joined(self, ids: list[int]) -> bytes:
        return b"".join([self.token[i] for i in ids])


class Pairing:
    """Two sides, and every pair of their tokens of which one is a suffix of the other, numbered in order of (a, b)."""

    def __init__(self, a_file: str, b_file: str):
        self.a, self.b = Side(a_file), Side(b_file)
        by_bytes: tuple[dict[bytes, list[int]], ...] = ({}, {})
        for side, found in zip((self.a, self.b), by_bytes, strict=True):
            for i, t in enumerate(side.token):
                found.setdefault(t, []).append(i)
        pairs = {(a, b) for a, t in enumerate(self.a.token) for k in range(len(t)) for b in by_bytes[1].get(t[k:], ())}
        pairs |= {(a, b) for b, t in enumerate(self.b.token) for k in range(1, len(t)) for a in by_bytes[0].get(t[k:], ())}
        self.shift = len(self.b.token)
        self.keys = np.sort(np.fromiter((a * self.shift + b for a, b in pairs), dtype=np.int64, count=len(pairs)))
        self.book = CodeBook(self._chunks)

    def _coded(self, texts: list[str]) -> list[list[int]]:
        """Each text's A ids and then its B ids, these from SECOND; BROKEN alone if one side's tokens don't join to space + text."""
        found = []
        for t, a, b in zip(texts, self.a.coded(texts), self.b.coded(texts), strict=True):
            whole = (" " + t).encode()
            found.append([*a, *(i + SECOND for i in b)] if self.a.joined(a) == whole == self.b.joined(b) else [BROKEN])
        return found

    def _chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = self._coded(chunks.to_pylist())
        sizes = np.array([len(x) for x in found], dtype=np.int64)
        return sizes, np.fromiter((i for x in found for i in x), dtype=np.int32, count=int(sizes.sum()))

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A ids of all texts, one after the other, and the texts' offsets; then those of B. A text with a broken chunk is coded whole, and has no ids if it's broken too."""
        ids, at = self.book.texts(*chunks_of(texts, self.a.chunked and self.b.chunked))
        places = np.flatnonzero(ids == BROKEN)
        for k in np.unique(np.searchsorted(at, places, side="right") - 1)[::-1].tolist():
            whole = [i for i in self._coded([texts[k].as_py()])[0] if i != BROKEN]
            ids = np.concatenate([ids[: at[k]], np.array(whole, dtype=np.int32), ids[at[k + 1] :]])
            at = np.concatenate([at[: k + 1], at[k + 1 :] + (len(whole) - (at[k + 1] - at[k]))])
        second = ids >= SECOND
        before = np.concatenate(([0], np.cumsum(second)))[at]
        return ids[~second], at - before, ids[second] - SECOND, before

    @property
    def b_of(self) -> np.ndarray:
        """The B token of each pair."""
        return self.keys % self.shift

    def number(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.keys, a.astype(np.int64) * self.shift + b).astype(np.int32)


def pairing(a_file: str, b_file: str) -> Pairing:
    """One per worker process."""
    return kept(f"alignment {a_file} {b_file}", lambda: Pairing(a_file, b_file))


def chunks_of(texts: pa.Array, cut: bool) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Codes of the chunks of space + text without the chunks' own space, each text's offsets, and the distinct chunks.

    Neither side joins a space to what stands before it, but for runs of white space: texts with those, or with white space at
    an end, are one chunk, as all are if not ``cut``. An empty text has no chunk.
    """
    whole = pc.match_substring_regex(texts, rf"^{_RUN}|{_RUN} | {_RUN}| \z") if cut else pc.is_valid(texts)
    split = pc.split_pattern(pc.if_else(whole, "", texts), " ")
    at = split.offsets.to_numpy().astype(np.int64)
    at = at - at[0]
    coded = split.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    distinct = coded.dictionary
    places = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
    if len(places):
        own = texts.take(pa.array(places)).dictionary_encode()
        codes[at[places]] = len(distinct) + own.indices.to_numpy(zero_copy_only=False)
        distinct = pa.concat_arrays([distinct, own.dictionary])
    empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    if empty.any():
        keep = np.ones(len(codes), dtype=bool)
        keep[at[:-1][empty]] = False
        at = np.concatenate(([0], np.cumsum(keep)))[at]
        codes = codes[keep]
    used = np.unique(codes)
    if len(used) < len(distinct):  # what whole texts and empty ones left behind
        distinct = distinct.take(pa.array(used))
        codes = np.searchsorted(used, codes).astype(np.int32)
    return codes, at, distinct


class Aligned:
    """A block of documents cut where both sides end a token: ids and token offsets of each side, and the places of tokens that end at a cut."""

    def __init__(self, pair: Pairing, texts: pa.Array):
        self.a, self.at_a, self.b, self.at_b = pair.texts(texts)
        ends_a, ends_b = np.cumsum(pair.a.lengths[self.a]), np.cumsum(pair.b.lengths[self.b])
        bytes_ = int(ends_a[-1]) + 1 if len(ends_a) else 1
        cut = (np.bincount(ends_a, minlength=bytes_) > 0) & (np.bincount(ends_b, minlength=bytes_) > 0)
        #: Cuts up to each byte, and the documents' byte offsets.
        self.cuts = np.cumsum(cut, dtype=np.int32)
        self.at = np.concatenate(([0], ends_a))[self.at_a]
        self.ends_a, self.ends_b = ends_a, ends_b
        self.last_a, self.last_b = cut[ends_a], cut[ends_b]

    @property
    def n_groups(self) -> np.ndarray:
        return np.diff(self.cuts[self.at]).astype(np.int64)

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A and B ids of all links, and each document's offsets in them: no token is empty, so one token of either side ends at a cut."""
        return self.a[self.last_a], self.b[self.last_b], self.cuts[self.at]

    def written(self) -> tuple[np.ndarray, np.ndarray]:
        """The groups of all documents as text ``a1,a2|b1;a3|b2,b3``, and each document's offsets in it."""
        # a token's place: behind its own side's tokens so far, and the other side's of the groups before (for B, of its own group too)
        group_a, group_b = self.cuts[self.ends_a - 1], self.cuts[self.ends_b - 1]
        n = int(self.cuts[-1]) + 1
        before_a, before_b = (np.concatenate(([0], np.cumsum(np.bincount(g, minlength=n)))) for g in (group_a, group_b))
        place_a = np.arange(len(self.a)) + before_b[group_a]
        place_b = np.arange(len(self.b)) + before_a[group_b + 1]
        ids = np.empty(len(self.a) + len(self.b), dtype=np.int32)
        ids[place_a], ids[place_b] = self.a, self.b
        mark = np.full(len(ids), ord(","), dtype=np.uint8)
        mark[place_a[self.last_a]], mark[place_b[self.last_b]] = ord("|"), ord(";")
        digits, width = _decimals(int(ids.max(initial=0)) + 1)
        rows, size = digits[ids], width[ids]
        rows[np.arange(len(ids)), size] = mark
        flat = rows[np.arange(rows.shape[1]) <= size[:, None]]
        ends = np.concatenate(([0], np.cumsum(size + 1)))
        return flat, ends[self.at_a + self.at_b]


def _decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal digits of the numbers under ``n``, with room for one more byte, and how many digits each has."""

    def make():
        numbers = [str(i).encode() for i in range(max(n, 1 << 17))]
        most = max(map(len, numbers)) + 1
        return np.frombuffer(b"".join(x.ljust(most) for x in numbers), dtype=np.uint8).reshape(len(numbers), most), np.array([len(x) for x in numbers], dtype=np.int64)

    if not hasattr(_decimals, "kept") or len(_decimals.kept[1]) < n:
        _decimals.kept = make()
    return _decimals.kept


def align(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """Per row: the id, the token ids ``a`` and ``b``, and ``cuts``, the byte offsets in space + text where both sides end a token."""

    def run(batches: Iterator[pa.RecordBatch]):
        pair = pairing(a_file, b_file)
        for block in blocks(batches, 1, BLOCK):
            got = Aligned(pair, block.column(1))
            lists = lambda at, flat: pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat))
            places = got.ends_a[got.last_a] - np.repeat(got.at[:-1], got.n_groups)
            yield pa.RecordBatch.from_arrays([block.column(0), lists(got.at_a, got.a), lists(got.at_b, got.b), lists(got.cuts[got.at], places.astype(np.int32))], names=[id_col, "a", "b", "cuts"])

    return arrow_map(df, [id_col, text_col], run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, a array<int>, b array<int>, cuts array<int>")


def _linked(df: DataFrame, id_col: str, text_col: str, a_file: str, b_file: str) -> DataFrame:
    """Per row: the id, its numbers and digest, and ``links``, the numbers of its links' pairs."""

    def run(batches: Iterator[pa.RecordBatch]):
        pair = pairing(a_file, b_file)
        for block in blocks(batches, 1, BLOCK):
            got = Aligned(pair, block.column(1))
            a, b, at = got.links()
            text, bounds = got.written()
            text = memoryview(text)
            bounds = bounds.tolist()
            digests = [hashlib.sha256(text[i : j - 1]).hexdigest() if j > i else "" for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
            links = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(pair.number(a, b)))
            yield pa.RecordBatch.from_arrays([block.column(0), *map(pa.array, (np.diff(got.at_a), np.diff(got.at_b), got.n_groups, np.diff(at).astype(np.int64), digests)), links], names=[id_col, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"])

    return arrow_map(df, [id_col, text_col], run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<int>")


def _counted(linked: DataFrame) -> DataFrame:
    """Corpus-wide: ``pair`` and ``n``, its links. A task sums its own first, in an array of the vocabularies' size."""

    def run(batches: Iterator[pa.RecordBatch]):
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            got = np.bincount(batch.column(0).flatten().to_numpy(), minlength=len(total))
            got[: len(total)] += total
            total = got
        pairs = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int32)), pa.array(total[pairs])], names=["pair", "n"])

    return arrow_map(linked, ["links"], run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def link_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """Id pairs with the number of links that hold them: ``a``, ``b``, ``n``. At most one row for each pair of a token and its suffix."""

    def run(batches: Iterator[pa.RecordBatch]):
        pair = pairing(a_file, b_file)
        for batch in batches:
            keys = pair.keys[batch.column(0).to_numpy()]
            yield pa.RecordBatch.from_arrays([pa.array((keys // pair.shift).astype(np.int32)), pa.array((keys % pair.shift).astype(np.int32)), batch.column(1)], names=["a", "b", "n"])

    return arrow_map(_counted(_linked(df, id_col, text_col, a_file, b_file)), ["pair", "n"], run, "a int, b int, n long")


def agreement(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """Per row: the id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best`` (links whose pair is the commonest of its B token), ``count_sum`` (over links) and ``groups_sha256``.

    The links are a table in the shared folder, which the result is read from; it stays for the caller to remove.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/alignment-{uuid.uuid4().hex}"
    _linked(df, id_col, text_col, a_file, b_file).write.option("compression", "zstd").parquet(folder)
    linked = spark.read.parquet(folder)
    counts = _counted(linked).toArrow()  # bounded by the vocabularies
    table = np.zeros(int(pc.max(counts.column(0)).as_py() or 0) + 1, dtype=np.int64)
    table[counts.column(0).to_numpy()] = counts.column(1).to_numpy()
    b_of = Pairing(a_file, b_file).b_of[: len(table)]
    most = np.zeros(int(b_of.max(initial=0)) + 1, dtype=np.int64)
    np.maximum.at(most, b_of, table)
    shared = spark.sparkContext.broadcast((table, table == most[b_of]))
    names = [id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]):
        n, best = shared.value
        for batch in batches:
            links = batch.column(6)
            pairs, at = links.flatten().to_numpy(), links.offsets.to_numpy().astype(np.int64)
            at = at - at[0]
            sums = [np.diff(np.concatenate(([0], np.cumsum(x[pairs], dtype=np.int64)))[at]) for x in (best, n)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *map(pa.array, sums), batch.column(5)], names=names)

    kind = df.schema[id_col].dataType.simpleString()
    return arrow_map(linked, [id_col, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"], run, f"{id_col} {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
