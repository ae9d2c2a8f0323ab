"""BPE encoding by a prefix-sharing trie, and decoding.

The distinct words of a block are walked in sorted order, which is the depth-first order of
their trie: the path from the root to the current node is a stack, and two neighbouring words
share the stack up to their common prefix. A node's state is the last token of the encoding of
its prefix. It follows from the states above it: the last token ``t`` of a prefix ends there, and
``t`` may follow the last token of what stands before it. Exactly one token does, so shared
prefixes are computed once, and a word's ids are read back from its node.

Results in special cases: a null or empty text has no ids and decodes to the empty text; special
strings in a text get their ids, as the library gives them by default; very long texts are encoded whole;
repeated rows each get their row; a null id stays null; an empty table gives an empty result;
columns other than the id and the text are never read.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm import _vocab
from lodestone.llm._common import arrow_map, blocks, kept


class TrieEncoder:
    """Encodes distinct words by a walk over their trie."""

    #: Remembered answers of ``follows``.
    MOST = 400_000

    def __init__(self, vocab: _vocab.Vocabulary):
        #: Token ids by their bytes, and bytes by id.
        self.by_bytes = {bytes(_vocab.CHAR_BYTE[c] for c in t): i for t, i in vocab.ids.items()}
        self.token = [b""] * vocab.size
        for b, i in self.by_bytes.items():
            self.token[i] = b
        for text, i in vocab.special.items():
            self.token[i] = text.encode()
        self.table = np.array(self.token, dtype=object)
        self.longest = max(map(len, self.by_bytes))
        #: An automaton over the vocabulary: a state is the longest suffix that starts some token.
        self.suffix = [b""]
        self.state = {b"": 0}
        for b in self.by_bytes:
            for k in range(1, len(b) + 1):
                if b[:k] not in self.state:
                    self.state[b[:k]] = len(self.suffix)
                    self.suffix.append(b[:k])
        self.moves: dict[int, int] = {}
        self.ending: list[tuple | None] = [None] * len(self.suffix)
        self.ranks = {pair: rank for rank, pair in enumerate(vocab.merges)}
        #: The pair that each token is merged from, and the rank of that merge.
        self.parts = {m: (pair, rank) for rank, (m, pair) in enumerate(zip(vocab.merged, vocab.merges, strict=True))}
        self.memo: dict[int, bool] = {}

    def follows(self, left: int, right: int) -> bool:
        """Whether BPE of the two tokens' joined bytes gives just these two tokens.

        Between them, BPE sees the symbols at the border: on the left those along the last parts
        of ``left``, on the right those along the first parts of ``right``, each growing at the
        rank of its merge. The tokens stay apart unless, at some time, the pair at the border
        has a lower rank than the next growth of either side (at equal rank the left place goes first).
        """
        key = left << 20 | right
        got = self.memo.get(key)
        if got is None:
            if len(self.memo) >= self.MOST:
                self.memo.clear()
            got = self.memo[key] = self._apart(left, right)
        return got

    def _apart(self, left: int, right: int) -> bool:
        parts, rank = self.parts, self.ranks.get
        # undo growth from the last to the first
        until_left = until_right = 1 << 30
        while True:
            border = rank((left, right))
            if border is not None and border < until_left and border <= until_right:
                return False
            grown_left, grown_right = parts.get(left), parts.get(right)
            if grown_left is None and grown_right is None:
                return True
            if grown_right is None or grown_left is not None and grown_left[1] > grown_right[1]:
                until_left, left = grown_left[1], grown_left[0][1]
            else:
                until_right, right = grown_right[1], grown_right[0][0]

    def move(self, at: int, byte: int) -> int:
        """The automaton's state after a byte."""
        key = at << 8 | byte
        got = self.moves.get(key)
        if got is None:
            if len(self.moves) >= self.MOST:
                self.moves.clear()
            text = self.suffix[at] + bytes((byte,))
            while text not in self.state:
                text = text[1:]
            got = self.moves[key] = self.state[text]
        if self.ending[got] is None:
            text = self.suffix[got]
            self.ending[got] = tuple((self.by_bytes[text[k:]], len(text) - k) for k in range(len(text)) if text[k:] in self.by_bytes)
        return got

    def encode(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and ids of the pieces, in their order."""
        texts = pieces.cast(pa.binary()).to_pylist()
        moves, ending, memo = self.moves, self.ending, self.memo
        # along the path to the current node: last token, its length, state of the automaton
        last, size, at = [-1], [0], [0]
        before = b""
        lengths = np.zeros(len(texts), dtype=np.int64)
        found: list[list[int]] = [[]] * len(texts)
        for k in sorted(range(len(texts)), key=texts.__getitem__):
            text = texts[k]
            shared = 0
            for a, b in zip(before, text, strict=False):
                if a != b:
                    break
                shared += 1
            del last[shared + 1 :], size[shared + 1 :], at[shared + 1 :]
            end, here = shared, at[-1]
            for byte in text[shared:]:
                end += 1
                here = moves.get(here << 8 | byte) or self.move(here, byte)
                for token, length in ending[here]:
                    if length == end:
                        break
                    key = last[end - length] << 20 | token
                    fits = memo.get(key)
                    if fits is None:
                        fits = self.follows(key >> 20, token)
                    if fits:
                        break
                last.append(token)
                size.append(length)
                at.append(here)
            ids = []
            while end:
                ids.append(last[end])
                end -= size[end]
            ids.reverse()
            found[k] = ids
            lengths[k] = len(ids)
            before = text
        return lengths, np.fromiter(chain.from_iterable(found), dtype=np.int32, count=int(lengths.sum()))

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are not UTF-8 become replacement characters."""
        return b"".join(self.table[ids].tolist()).decode("utf-8", "replace")


def encoder(file: str) -> tuple[TrieEncoder, _vocab.CodeBook]:
    """A file's trie encoder and the ids of chunks; one per worker process."""

    def make() -> tuple[TrieEncoder, _vocab.CodeBook]:
        vocab = _vocab.vocabulary(file)
        trie = TrieEncoder(vocab)
        return trie, _vocab.CodeBook(_vocab.chunk_encoder(vocab, _vocab.byte_pieces, trie.encode), marker=vocab.marker)

    return kept(f"trie {file}", make)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", file: str = "byte_bpe_50k.json") -> DataFrame:
    """Per row: the id and ``ids``, the token ids of the whole text."""

    def run(batches):
        _, book = encoder(file)
        for block in blocks(batches, 1):
            ids, at = book.texts(*_vocab.byte_chunks(block.column(1), book.marker))
            yield pa.RecordBatch.from_arrays([block.column(0), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))], names=[id_col, "ids"])

    return arrow_map(df, [id_col, text_col], run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", file: str = "byte_bpe_50k.json") -> DataFrame:
    """Per row: the id and ``text`` of its ``ids``; null ids give the empty text."""

    def run(batches):
        trie, _ = encoder(file)
        for batch in batches:
            texts = [trie.decode(np.asarray(x, dtype=np.int64)) if x else "" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return arrow_map(df, [id_col, ids_col], run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, text string")


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", file: str = "byte_bpe_50k.json") -> DataFrame:
    """Per row: the id, ``n_tokens``, and digests of the ids (``ids_sha256``) and of the text decoded from them (``decoded_sha256``).

    Encodes and decodes as ``encode`` and ``decode`` do, in one pass, without handing ids to the JVM.
    """

    def run(batches):
        trie, book = encoder(file)
        sha = hashlib.sha256
        for block in blocks(batches, 1):
            ids, at = book.texts(*_vocab.byte_chunks(block.column(1), book.marker))
            parts = [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            coded = [sha(p.astype("<u4").tobytes()).hexdigest() for p in parts]
            back = [sha(trie.decode(p).encode()).hexdigest() for p in parts]
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(np.diff(at)), pa.array(coded), pa.array(back)], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return arrow_map(df, [id_col, text_col], run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
