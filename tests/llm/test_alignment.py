"""Alignment of two tokenizers against a plain version that walks each text's tokens."""

import hashlib
import random
import re
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lodestone.llm import alignment, queries
from lodestone.llm._common import read
from lodestone.llm._vocab import CHAR_BYTE
from tests.llm.test_tokens import AWKWARD, random_texts


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path(alignment.A_FILE))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(alignment.B_FILE))


def ends(ids, parts):
    at, found = 0, []
    for i, p in zip(ids, parts, strict=True):
        at += len(p)
        found.append((at, i))
    return found


def one(libraries, text):
    """The groups of a text, None without tokens."""
    a, b = libraries
    text = text or ""
    coded = a.encode(" " + text, add_special_tokens=False)
    left = [bytes(CHAR_BYTE[c] for c in t) for t in coded.tokens]
    ids = b.encode(text)
    right = [bytes([int(m[1], 16)]) if (m := re.fullmatch("<0x(..)>", p)) else p.replace("▁", " ").encode() for p in map(b.id_to_piece, ids)]
    if not text or b"".join(left) != (" " + text).encode() or b"".join(right) != (" " + text).encode():
        return None
    left, right = ends(coded.ids, left), ends(ids, right)
    groups, here = [], ([], [])
    stops = {e for e, _ in left} & {e for e, _ in right}
    todo = sorted([(e, 0, i) for e, i in left] + [(e, 1, i) for e, i in right])
    for k, (e, side, i) in enumerate(todo):
        here[side].append(i)
        if e in stops and (k + 1 == len(todo) or todo[k + 1][0] > e):
            groups.append(here)
            here = ([], [])
    return groups


def plain(libraries, texts):
    found = [one(libraries, t) for t in texts]
    links = [[(a[-1], b[-1]) for a, b in g or ()] for g in found]
    count = Counter(x for row in links for x in row)
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    out = []
    for g, row in zip(found, links, strict=True):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g or ())
        out.append((sum(len(a) for a, _ in g or ()), sum(len(b) for _, b in g or ()), len(row), len(row), sum(count[x] == most[x[1]] for x in row), sum(count[x] for x in row), hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return out, count


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def hostile(n=500):
    pick = random.Random(3)
    return ["".join(pick.choice(["a", "B", " ", "  ", "▁", "\n", ".", "é", "1", "<|endoftext|>", "\xa0", "ﬁ", "\x00", "</s>", "日"]) for _ in range(pick.randint(0, 30))) for _ in range(n)]


def test_agreement(spark, libraries):
    texts = [*AWKWARD, *random_texts(), *hostile(), " lead", "trail ", " ", "x\n", "twice", "twice", "long words " * 30_000]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, links string").repartition(3)
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignment.agreement(df).collect()}
    want, count = plain(libraries, texts)
    assert got == dict(enumerate(want))
    assert any(w == (0,) * 6 + ("",) for w in want)
    assert {(r["a"], r["b"]): r["n"] for r in alignment.link_counts(df).collect()} == dict(count)


def test_align_gives_tokens_and_cuts(spark, libraries):
    texts = ["hello world, tokenizers", None, "日本語 ▁", "naïve cafés"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in alignment.align(df).collect():
        groups = one(libraries, texts[r["doc_id"]]) or []
        assert r["a"] == [i for a, _ in groups for i in a] and r["b"] == [i for _, b in groups for i in b]
        assert len(r["cuts"]) == len(groups) and (not groups or r["cuts"][-1] == len((" " + texts[r["doc_id"]]).encode()))


def test_ids_of_any_kind_and_empty_tables(spark):
    df = spark.createDataFrame([("x", "same text"), (None, "same text"), ("y", "")], "doc_id string, text string")
    rows = {r["doc_id"]: r for r in alignment.agreement(df).collect()}
    assert rows["x"]["n_links"] == rows[None]["n_links"] > 0 == rows["y"]["n_links"]
    assert rows["x"]["count_sum"] == 2 * rows["x"]["n_links"]
    assert alignment.agreement(df.where("false")).collect() == []


def test_pairs_are_bounded_by_the_vocabularies():
    pair = alignment.Pairing(alignment.A_FILE, alignment.B_FILE)
    assert len(pair.keys) <= int(2 * pair.a.lengths.sum() + pair.b.lengths.sum())
    a, b = pair.keys // pair.shift, pair.b_of
    for x, y in list(zip(a.tolist(), b.tolist(), strict=True))[::997]:
        assert pair.a.token[x].endswith(pair.b.token[y]) or pair.b.token[y].endswith(pair.a.token[x])


def test_query(spark, sf_dir, libraries):
    rows = read(spark, sf_dir, "documents").collect()
    want, _ = plain(libraries, [r["text"] for r in rows])
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in queries.QUERIES["op11_token_alignment"](spark, sf_dir).collect()}
    assert got == {r["doc_id"]: w for r, w in zip(rows, want, strict=True)}
