"""Public tokenizer files, and texts coded by cached white-space chunks.

A chunk is a part of a text that no pre-token crosses, so a chunk's ids depend on it alone. Texts
are cut into chunks in Arrow, distinct chunks are encoded once, and texts' ids are gathered.
"""

from __future__ import annotations

import json
import os
import weakref
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from lodestone.llm._common import LOWER, ragged, raw, words

#: Byte-level alphabet: printable bytes stand for themselves, the others for code points from 256.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_REST = [b for b in range(256) if b not in set(_PLAIN)]
BYTE_CHAR = {b: chr(b) for b in _PLAIN} | {b: chr(256 + i) for i, b in enumerate(_REST)}
CHAR_BYTE = {c: b for b, c in BYTE_CHAR.items()}

#: Below this code point Python's Unicode tables and the tokenizers library's agree; above, the library cuts.
AGREED = "\u0530"
#: Below this code point a text is its own NFC form.
COMPOSED = "\u0300"


def file_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Vocabulary:
    """A BPE file of the tokenizers library: ids, merges in rank order, and special tokens."""

    def __init__(self, name: str):
        from tokenizers import Tokenizer

        with open(file_path(name), encoding="utf-8") as f:
            found = json.load(f)
        model = found["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in found["added_tokens"]}
        self.merges = [tuple(self.ids[p] for p in (m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
        self.merged = [self.ids["".join(m.split(" ") if isinstance(m, str) else m)] if not self.suffix else self.ids[_glued(m)] for m in model["merges"]]
        self.library = Tokenizer.from_file(file_path(name))
        #: What every special string begins with: only texts with it can hold one. None without special strings.
        self.marker = os.path.commonprefix(list(self.special)) if self.special else None
        if any(c.isspace() for s in self.special for c in s):
            raise ValueError("special strings with white space cross chunks")
        self.special_cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")

    @property
    def size(self) -> int:
        return max(max(self.ids.values()), *self.special.values()) + 1


def _glued(merge) -> str:
    left, right = merge.split(" ") if isinstance(merge, str) else merge
    return left + right


_OPEN: weakref.WeakValueDictionary[str, Vocabulary] = weakref.WeakValueDictionary()


def vocabulary(name: str) -> Vocabulary:
    """A file's vocabulary, shared as long as something holds it."""
    found = _OPEN.get(name)
    if found is None:
        found = _OPEN[name] = Vocabulary(name)
    return found


#: The word file's pre-tokens.
_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
#: The byte file's pre-tokens.
_BYTE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: Unicode white space (and the separators 1C to 1F) beside a space: there, cutting before each space could part a run.
_RUN = r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def word_pieces(vocab: Vocabulary, text: str) -> list[str]:
    """Normalised pre-tokens of a text without special tokens, for the word file."""
    if text.isascii() or max(text) < COMPOSED:
        text = text.lower()
    else:
        text = vocab.library.normalizer.normalize_str(text)
        if max(text, default="") >= AGREED:
            return [text[i:j] for _, (i, j) in vocab.library.pre_tokenizer.pre_tokenize_str(text)]
    return [text] if text.isalpha() else _WORD.findall(text)


def byte_pieces(vocab: Vocabulary, text: str) -> list[str]:
    """Pre-tokens of a text without special tokens, for the byte file."""
    if text.isascii() or max(text) < AGREED:
        return [text] if text[1:].isalpha() and (text[0] == " " or text[0].isalpha()) else _BYTE.findall(text)
    return [text[i:j] for _, (i, j) in vocab.library.pre_tokenizer.pre_tokenize_str(text)]


def word_chunks(texts: pa.Array):
    """Chunks between ASCII white space, for the word file."""
    return words(texts)


def byte_chunks(texts: pa.Array, marker: str | None):
    """Chunks that start at each space, for the byte file; a text with a space in a longer white-space run, or with the marker of special strings, is one chunk."""
    joined = pc.match_substring_regex(texts, f"{_RUN} | {_RUN}")
    if marker is not None:
        joined = pc.or_(joined, pc.match_substring(texts, marker))
    whole = np.flatnonzero(joined.to_numpy(zero_copy_only=False))
    cut = texts
    if len(whole):
        cut = pc.if_else(joined, "", texts)
    split = pc.split_pattern(cut, " ")
    coded = split.flatten().dictionary_encode()
    at = split.offsets.to_numpy().astype(np.int64)
    at = at - at[0]
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    distinct = pc.binary_join_element_wise(" ", coded.dictionary, "")
    # a text's first chunk has no space before it; a text set aside above is its own first chunk
    starts = [t.as_py() for t in coded.dictionary.take(pa.array(codes[at[:-1]]))] if len(codes) else []
    for i in whole.tolist():
        starts[i] = texts[i].as_py()
    own = {t: len(distinct) + k for k, t in enumerate(dict.fromkeys(starts))}
    codes[at[:-1]] = [own[t] for t in starts]
    return codes, at, pa.concat_arrays([distinct, pa.array(list(own), pa.string())])


class CodeBook:
    """Ids of the chunks seen so far, in flat arrays; when it is full, only chunks of several blocks stay."""

    def __init__(self, encode, most: int = 300_000, most_bytes: int = 12 << 20, marker: str | None = None):
        self.encode, self.most, self.most_bytes, self.marker = encode, most, most_bytes, marker
        self.clear()

    def clear(self) -> None:
        self.known = pa.array([], pa.string())
        self.lengths = np.zeros(0, dtype=np.int64)
        self.starts = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.int32)
        self.hits = np.zeros(0, dtype=np.int32)

    def shrink(self) -> None:
        """Keeps the chunks that were looked up again, at most a half of what fits."""
        again = np.flatnonzero(self.hits > 1)
        kept = again[np.argsort(-self.hits[again], kind="stable")][: self.most // 2]
        chunks = self.known.take(pa.array(kept))
        lengths, ids = self.lengths[kept], self.ids[ragged(self.starts[kept], self.lengths[kept])]
        self.clear()
        if chunks.nbytes < self.most_bytes // 2:
            self.add(chunks, lengths, ids)

    def add(self, chunks: pa.Array, lengths: np.ndarray, ids: np.ndarray) -> None:
        self.known = pa.concat_arrays([self.known, chunks])
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.ids = np.concatenate([self.ids, ids])
        self.hits = np.concatenate([self.hits, np.zeros(len(chunks), dtype=np.int32)])

    def codes(self, chunks: pa.Array) -> np.ndarray:
        """Places of distinct chunks; they hold until the next call."""
        if len(self.known) + len(chunks) > self.most or self.known.nbytes > self.most_bytes:
            self.shrink()
        own = pc.fill_null(pc.index_in(chunks, self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = own < 0
        if new.any():
            own[new] = len(self.known) + np.arange(int(new.sum()))
            fresh = chunks.filter(pa.array(new))
            self.add(fresh, *self.encode(fresh))
        self.hits[own] += 1
        return own

    def texts(self, codes: np.ndarray, at: np.ndarray, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and each text's offsets."""
        own = self.codes(chunks)
        if not len(codes):
            return np.zeros(0, dtype=np.int32), np.zeros(len(at), dtype=np.int64)
        own = own[codes]
        lengths = self.lengths[own]
        ends = np.concatenate(([0], np.cumsum(lengths)))
        return self.ids[ragged(self.starts[own], lengths)], ends[at]

    def counts(self, codes: np.ndarray, at: np.ndarray, chunks: pa.Array) -> np.ndarray:
        """Ids in each text."""
        own = self.codes(chunks)
        ends = np.concatenate(([0], np.cumsum(self.lengths[own][codes]))) if len(codes) else np.zeros(1, dtype=np.int64)
        return np.diff(ends[at])


#: Kinds of ASCII bytes for the word file's pre-tokens: letters, digits, and all others.
_KIND = np.full(256, 2, dtype=np.uint8)
_KIND[97:123], _KIND[48:58] = 0, 1


def ascii_words(chunks: pa.Array, marker: str | None) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Which chunks are ASCII without an apostrophe or the marker's first character; for these the numbers of their pre-tokens under the word file, and the pre-tokens."""
    data, at = raw(chunks)
    odd = (data >= 128) | (data == 39)
    if marker is not None:
        odd |= data == marker.encode()[0]
    plain = np.diff(np.concatenate(([0], np.cumsum(odd)))[at]) == 0
    lengths = np.diff(at)
    if not plain.all():
        data, lengths = data[ragged(at[:-1][plain], lengths[plain])], lengths[plain]
        at = np.concatenate(([0], np.cumsum(lengths)))
    data = LOWER[data]
    kind = _KIND[data]
    begins = np.ones(len(data), dtype=bool)
    begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 1)  # each digit by itself
    begins[at[:-1][lengths > 0]] = True
    starts = np.append(np.flatnonzero(begins), len(data)).astype(np.int32)
    pieces = pa.Array.from_buffers(pa.string(), len(starts) - 1, [None, pa.py_buffer(starts.tobytes()), pa.py_buffer(data.tobytes())])
    return plain, np.diff(np.concatenate(([0], np.cumsum(begins)))[at]), pieces


def chunk_encoder(vocab: Vocabulary, pieces, encode_pieces, segment=None):
    """An ``encode`` of CodeBook: chunks to pre-tokens, distinct pre-tokens to ids by ``encode_pieces``, and together.

    ``segment`` cuts the chunks that it can in arrays; ``pieces`` cuts the others one by one.
    """
    marker = vocab.marker

    def cut(chunk: str) -> list:
        found: list = []
        for part in vocab.special_cut.split(chunk):
            found += [vocab.special[part]] if part in vocab.special else pieces(vocab, part) if part else []
        return found

    def encode(chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if segment is None:
            easy, sizes_easy, flat_easy = np.zeros(len(chunks), dtype=bool), np.zeros(0, dtype=np.int64), pa.array([], pa.string())
        else:
            easy, sizes_easy, flat_easy = segment(chunks, marker)
        coded = flat_easy.dictionary_encode()
        hard = chunks if segment is None else chunks.filter(pa.array(~easy))
        found = [pieces(vocab, c) if marker is None or marker not in c else cut(c) for c in hard.to_pylist()]
        sizes = np.empty(len(chunks), dtype=np.int64)
        sizes[easy] = sizes_easy
        sizes[~easy] = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        flat = list(chain.from_iterable(found))
        distinct = dict.fromkeys(flat)
        plain = [p for p in distinct if p.__class__ is str]
        known = pa.concat_arrays([coded.dictionary, pa.array(plain, pa.string())])
        lengths, ids = encode_pieces(known)
        if len(plain) < len(distinct):  # special tokens: pieces of one id, behind the others
            extra = [p for p in distinct if p.__class__ is int]
            lengths = np.concatenate([lengths, np.ones(len(extra), dtype=np.int64)])
            ids = np.concatenate([ids, np.asarray(extra, dtype=np.int32)])
            plain += extra
        base = len(coded.dictionary)
        place = dict(zip(plain, range(base, base + len(plain)), strict=True))
        begin = np.cumsum(sizes) - sizes
        own = np.empty(int(sizes.sum()), dtype=np.int64)
        own[ragged(begin[easy], sizes[easy])] = coded.indices.to_numpy(zero_copy_only=False)
        own[ragged(begin[~easy], sizes[~easy])] = np.fromiter(map(place.__getitem__, flat), dtype=np.int64, count=len(flat))
        starts = np.cumsum(lengths) - lengths
        taken = lengths[own]
        total = np.concatenate(([0], np.cumsum(taken)))
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        return np.diff(total[bounds]), ids[ragged(starts[own], taken)]

    return encode
