"""BPE by trie, token counts and packing against the tokenizers library."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from lodestone.llm import _vocab, bpe_trie, packing, token_counts

OPEN = [_vocab.vocabulary(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json")]  # held open

AWKWARD = [
    None, "", " ", "   ", "\n\n x", "a  b   c", "The the THE", "don't we'll I'M", "x" * 3000, "ab" * 700, "été ÉTÉ e\u0301", "ΣΑΣ İstanbul ſ", "日本語 テスト　全角", "🙂🙃 1² ½ ١٢",
    "<|endoftext|>", "a<|endoftext|> b <|startoftext|>c", "<|endof", "\x1c\x1d \x85 \u2028 \xa0 \u0300x", "tab\tand\r\nline \x0b\x0c", "word " * 2000, "  lead and trail  ",
]


def random_texts(n=300):
    pick = random.Random(5)
    return ["".join(pick.choice("aB c  \n\t.,'sé日１²!<|>\u0301\u3000") for _ in range(pick.randint(0, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts(spark):
    rows = list(enumerate([*AWKWARD, *random_texts()]))
    rows += [(1000, "twice"), (1000, "twice"), (None, "no id")]
    return rows, spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, n_tokens string")


def library(file, text):
    return _vocab.vocabulary(file).library.encode(text or "", add_special_tokens=False).ids


def test_round_trip(texts):
    rows, df = texts
    got = sorted(map(str, (tuple(r) for r in bpe_trie.round_trip(df).collect())))
    want = []
    for i, t in rows:
        ids = library("byte_bpe_50k.json", t)
        back = _vocab.vocabulary("byte_bpe_50k.json").library.decode(ids, skip_special_tokens=False)
        want.append(str((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())))
    assert got == sorted(want)


def test_encode_decode(spark, texts):
    rows, df = texts
    coded = bpe_trie.encode(df)
    assert sorted((str(r["doc_id"]), list(r["ids"])) for r in coded.collect()) == sorted((str(i), library("byte_bpe_50k.json", t)) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["text"]) for r in bpe_trie.decode(coded).collect()) == sorted((str(i), t or "") for i, t in rows)
    broken = spark.createDataFrame([(1, [165, 121]), (2, None)], "doc_id long, ids array<int>")
    wanted = _vocab.vocabulary("byte_bpe_50k.json").library.decode([165, 121], skip_special_tokens=False)
    assert {r["doc_id"]: r["text"] for r in bpe_trie.decode(broken).collect()} == {1: wanted, 2: ""}


def test_merges_come_after_their_parts():
    for file in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        vocab = _vocab.vocabulary(file)
        assert all(m > max(p) for p, m in zip(vocab.merges, vocab.merged, strict=True))


def test_pair_check_is_plain_bpe():
    trie, _ = bpe_trie.encoder("byte_bpe_50k.json")
    pick, merged = random.Random(3), _vocab.vocabulary("byte_bpe_50k.json").merged
    for _ in range(1500):
        left, right = pick.randrange(256, 4000), pick.randrange(256, 4000)
        ids = [trie.by_bytes[bytes((b,))] for b in trie.token[left] + trie.token[right]]
        while True:
            ranks = [trie.ranks.get(p, 1 << 30) for p in zip(ids, ids[1:], strict=False)]
            if not ranks or min(ranks) == 1 << 30:
                break
            k = ranks.index(min(ranks))
            ids[k : k + 2] = [merged[ranks[k]]]
        assert trie.follows(left, right) == (ids == [left, right])


def test_counts(texts):
    rows, df = texts
    got = sorted(str(tuple(r)) for r in token_counts.count_tokens(df, limit=100).collect())
    n = [len(library("word_bpe_49k.json", t)) for _, t in rows]
    assert got == sorted(str((i, len((t or "").encode()), k, k > 100)) for (i, t), k in zip(rows, n, strict=True))


def test_cache_overflow_changes_nothing():
    vocab = _vocab.vocabulary("word_bpe_49k.json")
    merger = token_counts.RankMerger(vocab)
    book = _vocab.CodeBook(_vocab.chunk_encoder(vocab, _vocab.word_pieces, merger.encode, _vocab.ascii_words), most=50)
    import pyarrow as pa

    pick = random.Random(9)
    for _ in range(20):
        block = [" ".join(pick.choice(["the", "thing", "of", "w%d" % pick.randrange(500)]) for _ in range(40)) for _ in range(3)]
        ids, at = book.texts(*_vocab.word_chunks(pa.array(block)))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [library("word_bpe_49k.json", t) for t in block]


def test_packing(texts):
    rows, df = texts
    pieces = packing.pack(df).collect()
    by_id = defaultdict(list)
    for p in pieces:
        by_id[p["doc_id"]].append(p)
    for key, own in by_id.items():
        found = [t for i, t in rows if i == key]
        ids = [*library("word_bpe_49k.json", found[0]), 2]
        for start in {p["start"] for p in own}:
            same = [p for p in own if p["start"] == start]
            assert len(same) == len(found)  # once for each repeated row
        at = 0
        for p in sorted({(p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]) for p in own}):
            assert p[0] == at and p[2] == zlib.crc32(np.array(ids[at : at + p[1]], "<u4").tobytes()) and p[3] == len(ids)
            at += p[1]
        assert at == len(ids)
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096 and at & (at - 1) == 0  # no padding at all
    assert {i for i, _ in rows} == set(by_id)


def packed_by(lengths, capacity):
    """Bins of one worker after documents of these lengths; ids are numbered through."""
    bins, start = packing.Bins(capacity), 0
    for i, n in enumerate(lengths):
        bins.add(packing.Piece(i, 0, np.arange(start, start + n, dtype="<u4"), n))
        start += n
    return bins


def test_harmonic_classes():
    """Class k holds lengths over C / (k + 1) and at most C / k, and its bins k whole documents."""
    bins = packed_by([64, 64 + 5, *[20, 17, 21] * 20, *[40] * 3, 3, 3], 64)
    assert [sum(len(p.ids) for p in own) for own in bins.done[:2]] == [64, 64]
    for own in bins.done[2:]:
        first = 64 // len(own[0].ids)
        assert sum(len(p.ids) for p in own) == 64 and all(64 // len(p.ids) == first and len(p.ids) == p.total for p in own[:first])
    assert all(len(held) < k and all(64 // (k + 1) < len(p.ids) <= 64 // k for p in held) for k, held in bins.open.items())


def test_packing_of_any_lengths():
    pick = random.Random(21)
    for trial in range(60):
        capacity = 1 << pick.randint(3, 8)
        lengths = [max(1, int(pick.paretovariate(0.8) * 3)) % (5 * capacity) + 1 for _ in range(pick.choice([0, 1, 5, 60, 400]))]
        bins = packed_by(lengths, capacity)
        held = sum(len(p.ids) for own in bins.open.values() for p in own)
        assert held <= 2 * capacity * capacity.bit_length() * 4
        bins.close()
        sizes = [sum(len(p.ids) for p in own) for own in bins.done]
        rest = [n for n in sizes if n != capacity]
        assert all(n & (n - 1) == 0 for n in rest) and len(set(rest)) == len(rest), trial
        assert sorted(np.concatenate([p.ids for own in bins.done for p in own]).tolist() if lengths else []) == list(range(sum(lengths)))
        for own in bins.done:
            assert all(p.ids[0] == sum(lengths[: p.key]) + p.start and p.total == lengths[p.key] for p in own)


def test_documents_stay_whole(spark):
    """Of documents that fit a sequence nine in ten are one piece, and the pieces are hardly more than the documents and the sequences."""
    pieces = packing.pack(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").coalesce(1)).toPandas()
    fits = pieces[pieces.doc_tokens <= 4096].groupby("doc_id").size()
    assert (fits == 1).mean() > 0.9
    assert len(pieces) < pieces.doc_id.nunique() + 1.3 * pieces.sequence_id.nunique()


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    for f in (bpe_trie.round_trip, bpe_trie.encode, token_counts.count_tokens, packing.pack):
        assert f(none).count() == 0
