"""Token counts by rank-synchronous array merging.

Distinct pre-tokens of a block are held as ragged numpy arrays of symbols. In each round every
sequence finds its lowest-rank adjacent pair and merges all its occurrences, all sequences at
once; sequences without a pair leave the arrays. The symbols that survive are the tokens.

Results in special cases: a null or empty text has 0 tokens; very long texts are counted whole;
repeated rows each get their row; a null id stays null; an empty table gives an empty result;
columns other than the id and the text are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm import _vocab
from lodestone.llm._common import arrow_map, blocks, kept, offsets, raw

NONE = np.int32(2**31 - 1)


class RankMerger:
    """Applies a vocabulary's merges to many symbol sequences at once."""

    def __init__(self, vocab: _vocab.Vocabulary):
        self.width = np.int64(vocab.size)
        pairs = np.asarray(vocab.merges, dtype=np.int64)
        keys = pairs[:, 0] * self.width + pairs[:, 1]
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.result = np.asarray(vocab.merged, dtype=np.int32)
        self.byte = np.array([vocab.ids[_vocab.BYTE_CHAR[b]] for b in range(256)], dtype=np.int32)
        #: The last byte of a word has an id of its own where the file marks word ends.
        self.last = np.array([vocab.ids[_vocab.BYTE_CHAR[b] + vocab.suffix] for b in range(256)], dtype=np.int32)

        #: Ranks of pairs of single bytes, by (left id, right id).
        small = (pairs < self.SMALL).all(axis=1)
        self.first = np.full(self.SMALL * self.SMALL, NONE, dtype=np.int32)
        self.first[pairs[small, 0] * self.SMALL + pairs[small, 1]] = np.flatnonzero(small)

    #: Above the ids of single bytes, with and without a word's end.
    SMALL = 512

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left * self.width + right
        at = np.searchsorted(self.keys, wanted)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == wanted, self.ranks[at], NONE)

    def symbols(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, at = raw(pieces)
        lengths = np.diff(at).astype(np.int64)
        out = self.byte[data]
        ends = np.cumsum(lengths)[lengths > 0] - 1
        out[ends] = self.last[data[ends]]
        return lengths, out

    def rounds(self, pieces: pa.Array):
        """Yields (sequence numbers, lengths, symbols) of the sequences that each round finishes."""
        lengths, sym = self.symbols(pieces)
        seq = np.flatnonzero(lengths)
        lengths = lengths[seq]
        rank = np.full(len(sym), NONE, dtype=np.int32)
        if len(sym) > 1:
            rank[:-1] = self.first[sym[:-1] * self.SMALL + sym[1:]]
            rank[np.cumsum(lengths) - 1] = NONE
        while len(seq):
            starts = np.cumsum(lengths) - lengths
            lowest = np.minimum.reduceat(rank, starts)
            ended = lowest == NONE
            if ended.any():
                gone = np.repeat(ended, lengths)
                yield seq[ended], lengths[ended], sym[gone]
                seq, lengths, lowest = seq[~ended], lengths[~ended], lowest[~ended]
                sym, rank = sym[~gone], rank[~gone]
                if not len(seq):
                    return
            hit = np.flatnonzero(rank == np.repeat(lowest, lengths))
            # a pair of equal symbols may overlap the next: in a run of hits every second one merges
            breaks = np.concatenate(([True], np.diff(hit) != 1))
            first = np.maximum.accumulate(np.where(breaks, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - first) % 2 == 0]
            sym[hit] = self.result[rank[hit]]
            keep = np.ones(len(sym), dtype=bool)
            keep[hit + 1] = False
            owner = np.repeat(np.arange(len(seq)), lengths)
            merged = np.cumsum(keep)[hit] - 1
            lengths = lengths - np.bincount(owner[hit], minlength=len(seq))
            sym, rank = sym[keep], rank[keep]
            ends = np.cumsum(lengths) - 1
            for at in (merged, merged[merged > 0] - 1):
                rank[at] = self.rank(sym[at], sym[np.minimum(at + 1, len(sym) - 1)])
            rank[ends] = NONE

    def counts(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Surviving symbols of each piece; no ids."""
        out = np.zeros(len(pieces), dtype=np.int64)
        for seq, lengths, _ in self.rounds(pieces):
            out[seq] = lengths
        return out

    def encode(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and ids of the pieces."""
        lengths, found = np.zeros(len(pieces), dtype=np.int64), []
        for seq, own, sym in self.rounds(pieces):
            lengths[seq] = own
            found.append((seq, own, sym))
        out = np.empty(int(lengths.sum()), dtype=np.int32)
        starts = np.cumsum(lengths) - lengths
        for seq, own, sym in found:
            out[_vocab.ragged(starts[seq], own)] = sym
        return lengths, out


def word_book(name: str) -> _vocab.CodeBook:
    """Ids of white-space chunks under a word file; one per worker process."""

    def make() -> _vocab.CodeBook:
        vocab = _vocab.vocabulary(name)
        return _vocab.CodeBook(_vocab.chunk_encoder(vocab, _vocab.word_pieces, RankMerger(vocab).encode, _vocab.ascii_words))

    return kept(f"ids {name}", make)


def count_book(name: str) -> _vocab.CodeBook:
    """As word_book, with surviving symbols counted only: each symbol stands as a 0."""

    def make() -> _vocab.CodeBook:
        vocab = _vocab.vocabulary(name)
        merger = RankMerger(vocab)

        def count(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            lengths = merger.counts(pieces)
            return lengths, np.zeros(int(lengths.sum()), dtype=np.int32)

        return _vocab.CodeBook(_vocab.chunk_encoder(vocab, _vocab.word_pieces, count, _vocab.ascii_words))

    return kept(f"counts {name}", make)


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", file: str = "word_bpe_49k.json", limit: int = 2048) -> DataFrame:
    """Per row: the id, ``n_bytes`` in UTF-8, ``n_tokens`` under the vocabulary ``file``, ``over_limit`` (more than ``limit``)."""

    def run(batches):
        book = count_book(file)
        for block in blocks(batches, 1):
            texts = block.column(1)
            n_bytes = np.diff(offsets(texts)).astype(np.int64)
            n = book.counts(*_vocab.word_chunks(texts))
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(n_bytes), pa.array(n), pa.array(n > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    return arrow_map(df, [id_col, text_col], run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
