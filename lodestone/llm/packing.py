"""Harmonic packing of documents into training sequences.

Lengths up to the capacity C fall into reciprocal-capacity classes: class k has the documents of over C / (k + 1) and
at most C / k tokens, and each of its bins takes k of them, whole. What such a bin leaves open takes whole documents of smaller classes, as far as
they are at hand, and then a cut of one document, the worker's stock, so that a full bin has no padding. The stock is the rest of a document over C (which
is cut into full sequences anyway), or else a document of the largest class of lengths that is open. Only documents over C and
stock are cut; all others keep their context in one piece.

Each worker fills its own bins as its rows stream by. It holds fewer than k documents for each of the 127 classes that
C = 4096 has, one bin that waits for stock, and the stock: a bounded number of tokens. At its end, what open bins hold is laid end to end into full
sequences, largest documents first, and the last rest into sequences whose lengths are distinct powers of two, which need
no padding either. A sequence lies in one partition, so no row moves.

Sequence ids carry the partition number, and depend on the order of rows in a partition: read the
input from a table (not from a shuffle of unstable order) so that a retried task gives the same pieces.

Results in special cases: a null or empty text is the end token alone; very long texts are cut into many
pieces; repeated rows and ids are packed each for itself; a null id stays null; an empty table
gives an empty result; columns other than the id and the text are never read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lodestone.llm import _vocab
from lodestone.llm._common import arrow_map, blocks
from lodestone.llm.token_counts import word_book

CAPACITY = 4096


@dataclass(slots=True)
class Piece:
    """A run of a document's ids: of ``key``'s ``total`` ids those from ``start`` on."""

    key: object
    start: int
    ids: np.ndarray
    total: int

    def split(self, n: int) -> tuple[Piece, Piece | None]:
        """Its first ``n`` ids, and the rest."""
        if n >= len(self.ids):
            return self, None
        return Piece(self.key, self.start, self.ids[:n], self.total), Piece(self.key, self.start + n, self.ids[n:], self.total)


class Bins:
    """One worker's open bins. ``done`` has its sequences in order, for the caller to take away."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity = capacity
        self.done: list[list[Piece]] = []
        #: Documents in open bins, by class.
        self.open: dict[int, list[Piece]] = {}
        #: The document that gaps are closed from, and the one bin that waits for such a document.
        self.stock: Piece | None = None
        self.waiting: list[Piece] = []
        self.gap = 0

    def add(self, piece: Piece) -> None:
        """Takes a whole document."""
        while len(piece.ids) > self.capacity:
            full, piece = piece.split(self.capacity)
            self.done.append([full])
        if len(piece.ids) == self.capacity:
            self.done.append([piece])
        elif self.stock is None and (piece.start or self.waiting):
            self.stock = piece
            self.fill()
        else:
            k = self.capacity // len(piece.ids)
            held = self.open.setdefault(k, [])
            held.append(piece)
            if len(held) == k:
                del self.open[k]
                self.waiting, self.gap = held, self.capacity - sum(len(p.ids) for p in held)
                self.fill()

    def taken(self, k: int) -> Piece:
        """A document out of the open bin of class ``k``."""
        piece = self.open[k].pop()
        if not self.open[k]:
            del self.open[k]
        return piece

    def fill(self) -> None:
        """Closes the bin that waits with whole documents of the classes within its gap, then from the stock, or else from the open document of the largest class."""
        if not self.waiting:
            return
        while self.gap and (self.stock is not None or self.open):
            within = min((k for k in self.open if self.capacity // k <= self.gap), default=0)
            if within:
                part = self.taken(within)
            else:
                part, self.stock = (self.stock or self.taken(min(self.open))).split(self.gap)
            self.waiting.append(part)
            self.gap -= len(part.ids)
        if not self.gap:
            self.done.append(self.waiting)
            self.waiting = []

    def close(self) -> None:
        """Lays what is left end to end: full sequences, and a rest in distinct powers of two."""
        held = sorted((p for own in self.open.values() for p in own), key=lambda p: -len(p.ids))
        left = self.waiting + held + ([self.stock] if self.stock is not None else [])
        room = total = sum(len(p.ids) for p in left)
        sizes = [self.capacity] * (total // self.capacity)
        room -= self.capacity * len(sizes)
        sizes += [1 << b for b in reversed(range(room.bit_length())) if room >> b & 1]
        left.reverse()
        for size in sizes:
            own: list[Piece] = []
            while size:
                part, rest = left.pop().split(size)
                own.append(part)
                size -= len(part.ids)
                if rest is not None:
                    left.append(rest)
            self.done.append(own)
        self.open, self.stock, self.waiting = {}, None, []


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", file: str = "word_bpe_49k.json", end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """Per piece: the id, ``start`` and ``length`` in the document's ids, ``ids_crc32`` of them, ``doc_tokens``, ``sequence_id`` and ``offset``.

    A document's ids are those of its whole text and ``end_id``. Sequences of ``capacity`` tokens are full;
    the others have a power of two.
    """
    if capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")

    def run(batches):
        book = word_book(file)
        bins, number, kind = Bins(capacity), TaskContext.get().partitionId() << 33, None

        def record() -> pa.RecordBatch:
            nonlocal number
            rows = []
            for own in bins.done:
                at = 0
                for p in own:
                    n = len(p.ids)
                    rows.append((p.key, p.start, n, zlib.crc32(p.ids), p.total, number, at))
                    at += n
                number += 1
            bins.done.clear()
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:])], names=names)

        for block in blocks(batches, 1):
            kind = block.column(0).type
            ids, at = book.texts(*_vocab.word_chunks(block.column(1)))
            ids = ids.astype("<u4")
            for key, a, b in zip(block.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                own = np.empty(b - a + 1, dtype="<u4")  # a copy: pieces in open bins outlive the block
                own[:-1], own[-1] = ids[a:b], end_id
                bins.add(Piece(key, 0, own, len(own)))
            if bins.done:
                yield record()
        bins.close()
        if bins.done:
            yield record()

    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return arrow_map(df, [id_col, text_col], run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
