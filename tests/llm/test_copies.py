"""SimHash, MinHash and components against brute force."""

import decimal
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
import xxhash

from lodestone.llm import components, minhash, queries, simhash
from lodestone.shared import read


def word_list(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_print(text):
    found = word_list(text)
    shingles = [" ".join(found[i : i + 3]) for i in range(len(found) - 2)] if len(found) > 2 else ([" ".join(found)] if found else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def classes(nodes, near):
    root = {n: n for n in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and near(a, b):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {n: top(n) for n in nodes}


def test_covering_guarantee():
    pick = random.Random(1)
    for positions in (list(range(64)), list(range(30)), list(range(14))):
        masks = simhash.covering(3, positions)
        for _ in range(3000):
            changed = sum(1 << p for p in pick.sample(positions, 3))
            assert any(not m & changed for m in masks)


def test_simhash_query(spark, sf_dir):
    rows = {r["doc_id"]: r for r in queries.op7_simhash_covering(spark, sf_dir).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    prints = {i: brute_print(t) for i, t in texts.items()}
    assert {i: r["fingerprint"] for i, r in rows.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r["component_id"] for i, r in rows.items()} == classes(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)


def test_links_of_crowded_buckets(spark, monkeypatch):
    pick = random.Random(2)
    monkeypatch.setattr(simhash, "MOST", 8)  # so that buckets are split level by level
    bits = set()
    for _ in range(4):
        center = pick.getrandbits(64)
        for _ in range(40):
            bits.add(center ^ sum(1 << p for p in pick.sample(range(64), pick.randint(0, 4))))
    bits = sorted(bits)
    df = spark.createDataFrame([(i, simhash.signed(b), 0) for i, b in enumerate([*bits, bits[0], bits[0]])], "node long, bits long, salt int")
    found = {tuple(r) for r in components.connected_components(simhash.links(df)).select("node", "root").collect()}
    every = [*bits, bits[0], bits[0]]
    want = classes(range(len(every)), lambda a, b: (every[a] ^ every[b]).bit_count() <= 3)
    got = dict(found)
    assert {n: got.get(n, n) for n in want} == want


def test_simhash_cases(spark):
    rows = [(1, None), (2, ""), (3, "a b c d"), (3, "a b c d"), (4, "A B C D"), (None, "a b c d"), (5, "one two"), (6, "q " * 20000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, bits int")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    by = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in got}
    assert by[1, "0" * 16] == by[2, "0" * 16] == 1
    assert {r["component_id"] for r in got if r["doc_id"] in (3, 4)} == {3}
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [3]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def jaccard(a, b, width):
    def shingles(t):
        w = word_list(t)
        return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def edits(seed=7):
    """Groups of near copies (one or two words of 120 changed), loose relatives and strangers."""
    pick = random.Random(seed)
    word = lambda: "".join(pick.choice("abcdefghij") for _ in range(6))
    out, number = [], 0
    for _ in range(25):
        base = [word() for _ in range(120)]
        for n in (0, 1, 2, 0, 30):
            own = list(base)
            for at in pick.sample(range(120), n):
                own[at] = word()
            out.append((number, " ".join(own)))
            number += 1
    return out


@pytest.mark.parametrize("pivots", [0, 1, 4])
def test_deduplicated(spark, monkeypatch, pivots):
    monkeypatch.setattr(simhash, "PIVOTS", pivots)
    rows = edits()
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows] + [(900, None, "en", "s", 0), (901, "", "en", "s", 0), (None, "x", "en", "s", 1), (0, rows[0][1], "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 2)  # so that classes are dealt into blocks
    kept = simhash.deduplicated(df)
    assert kept.columns == df.columns
    got = sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
    texts = dict(rows)
    want = classes(sorted(texts), lambda a, b: jaccard(texts[a], texts[b], 5) >= 0.8)
    assert got == sorted({*want.values(), 900})
    assert kept.where("doc_id is null").count() == 1
    assert simhash.deduplicated(df.limit(0)).count() == 0


@pytest.mark.parametrize("pivots", [0, 1, 3, 8])
def test_similar_links_of_large_classes(spark, monkeypatch, pivots):
    """Chains of texts of which only neighbours are alike, so that most links lie far from any pivot, beside a large group of copies."""
    monkeypatch.setattr(simhash, "PIVOTS", pivots)
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 7)
    monkeypatch.setattr(simhash, "SETTLED", 0.3 if pivots == 3 else 0)
    pick = random.Random(41)
    word = lambda: "".join(pick.choice("abcdefghij") for _ in range(6))
    stream = [word() for _ in range(700)]
    texts = [" ".join(stream[4 * k : 4 * k + 100]) for k in range(130) if pick.random() < 0.7]
    base = [word() for _ in range(100)]
    for _ in range(40):  # within 0.8 of the base, hardly of each other
        own = list(base)
        own[pick.randrange(100)] = word()
        texts.append(" ".join(own))
    texts += [" ".join(base[:70] + [word() for _ in range(30)]) for _ in range(20)]
    pick.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    classes_ = spark.createDataFrame([(i, i % 2 if i < 6 else 1) for i in range(len(texts))], "node long, root long")
    got = {r["node"]: r["root"] for r in components.connected_components(simhash.similar_links(df, classes_, "id", "text")).collect()}
    root = {r["node"]: r["root"] for r in classes_.collect()}
    want = classes(range(len(texts)), lambda a, b: root[a] == root[b] and jaccard(texts[a], texts[b], 5) >= 0.8)
    assert {i: got.get(i, i) for i in want} == want
    assert 5 < len(set(want.values())) < 60


def runs(seed=19):
    """Copies made by adding, cutting or replacing one run of words, 0.80 to 0.95 alike, in groups of three with a relative under 0.8."""
    pick = random.Random(seed)
    word = lambda: "".join(pick.choice("abcdefghij") for _ in range(6))
    out = []
    for size in (60, 150, 400, 900):
        for like in (0.8, 0.83, 0.88, 0.93):
            base = [word() for _ in range(size)]
            n = size - 4  # shingles
            added = int(n / like) - n
            cut = n - -int(-n * like // 1)
            gone = max(1, int(n * (1 - like) / (1 + like)) - 4)
            at = pick.randrange(5, size - gone - 5)
            appended = base + [word() for _ in range(added)]
            replaced = base[:at] + [word() for _ in range(gone)] + base[at + gone :]
            for text in (base, appended, base[cut:], replaced, base[: size // 2] + [word() for _ in range(size // 2)]):
                out.append((len(out), " ".join(text)))
    return out


def test_deduplicated_runs(spark):
    rows = runs()
    texts = dict(rows)
    alike = [jaccard(texts[i], texts[i - i % 5], 5) for i in texts if i % 5 in (1, 2, 3)]
    assert sum(0.8 <= x < 0.96 for x in alike) >= 44
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = classes(sorted(texts), lambda a, b: a // 5 == b // 5 and jaccard(texts[a], texts[b], 5) >= 0.8)
    assert sorted(r["doc_id"] for r in simhash.deduplicated(df).collect()) == sorted(set(want.values()))


def test_links_of_crowded_bands(spark, monkeypatch):
    monkeypatch.setattr(minhash, "MOST", 3)  # so that buckets are dealt into blocks
    pick = random.Random(23)
    word = lambda: "".join(pick.choice("abcdefghij") for _ in range(6))
    shared = [word() for _ in range(100)]
    rows = []
    for _ in range(12):  # relatives under 0.8 that share a passage, each with a copy over 0.8
        own = shared + [word() for _ in range(20)]
        rows += [(len(rows), " ".join(own)), (len(rows) + 1, " ".join(own + [word() for _ in range(20)]))]
    texts = dict(rows)
    df = spark.createDataFrame(rows, "node long, text string")
    root = {r["node"]: r["root"] for r in components.connected_components(minhash.links(minhash.fingerprints(df, "node"))).collect()}
    near = [(a, b) for a in texts for b in texts if a < b and jaccard(texts[a], texts[b], 5) >= 0.8]
    assert len(near) >= 12 and all(root[a] == root[b] for a, b in near)


def test_components(spark):
    pick = random.Random(4)
    pairs = [(pick.randrange(400), pick.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(500, 560)] + [(700, k) for k in range(701, 760)] + [(3, 3), (None, 4)]
    df = spark.createDataFrame(pairs, "a long, b long")
    links = {frozenset(p) for p in pairs if None not in p}
    nodes = sorted({x for p in pairs if None not in p for x in p if p[0] != p[1]})
    got = {r["node"]: r["root"] for r in components.connected_components(df).collect()}
    assert got == classes(nodes, lambda a, b: frozenset((a, b)) in links)
    assert components.connected_components(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def minhash_rows(spark):
    rows = edits(3)[:60] + [(100, None), (101, ""), (102, "ab"), (103, "a b c"), (104, "long " * 9000), (105, rows_text := "twin text of some words here"), (105, rows_text), (107, "日本 " * 50)]
    return rows, spark.createDataFrame([(i, t, 0.5) for i, t in rows], "doc_id long, text string, near_next double")


def test_edits(minhash_rows):
    rows, df = minhash_rows
    got = minhash.fingerprint_edits(df).collect()
    order = sorted(rows, key=lambda r: -r[0])
    want = []
    for (i, t), (_, following) in zip(order, [*order[1:], order[0]], strict=True):
        t, following = t or "", following or ""
        third = len(t) // 3
        want.append((i, len(t), hashlib.sha256((t[: len(t) - third] + following[:third]).encode()).hexdigest()))
    assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == sorted(want)
    prints = {}
    for r in got:
        text = dict(rows)[r["doc_id"]] or ""
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    error = []
    texts = {i: t or "" for i, t in rows}
    for (i, _), (j, _) in zip(order, [*order[1:], order[0]], strict=True):
        near = next(r["near_next"] for r in got if r["doc_id"] == i)
        error.append(abs(near - jaccard(texts[i], texts[j], 5)) if i != j else 0)
    assert np.mean(error) < 0.05


def test_fingerprints_by_definition():
    """Minima of a * x + b modulo 2**32 over the shingles, one permutation after the other."""
    import pyarrow as pa

    a, b = minhash._permutations()
    texts = ["a b c d e f g", "One two", "", "x y z x y z x y z", "日本 words and \t more of them here"]
    hashes, at = minhash.shingles(pa.array(texts), minhash._Hashes())
    got = minhash.signatures(hashes, at)
    for k, t in enumerate(texts):
        found = word_list(t)
        own = [int(x) >> 32 for x in hashes[at[k] : at[k + 1]]]
        assert len(own) == (0 if not found else max(1, len(found) - 4))
        assert len(set(own)) == len({tuple(found[i : i + 5]) for i in range(len(own))})
        assert got[k].tolist() == [min(((int(p) * x + int(q)) % 2**32 for x in own), default=2**32 - 1) for p, q in zip(a, b, strict=True)]
    same = minhash.bytes_of(got)
    for i in range(len(texts)):
        for j in range(len(texts)):
            equal = sum(x == y for x, y in zip(same[i].tolist(), same[j].tolist(), strict=True)) / 128
            assert minhash.likeness(same[i], same[j]) == pytest.approx(max(0, (equal - 1 / 256) / (255 / 256)))


def test_edits_of_hot_ids(spark):
    """One id, and rows without an id, that hold most rows: in the order of their texts' hashes, over many ranges."""
    pick = random.Random(5)
    rows = [(7, f"hot {i} " + "x" * pick.randrange(30)) for i in range(150)] + [(None, f"none {i} " + "y" * pick.randrange(30)) for i in range(120)]
    rows += [(i, f"own {i} text") for i in range(20)] + [(7, "hot 3 twice")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    signed = lambda t: simhash.signed(xxhash.xxh64_intdigest(t.encode(), 42))
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), signed(r[1])))
    want = []
    for (i, t), (_, following) in zip(order, [*order[1:], order[0]], strict=True):
        third = len(t) // 3
        want.append((str(i), len(t), hashlib.sha256((t[: len(t) - third] + following[:third]).encode()).hexdigest()))
    got = minhash.fingerprint_edits(df)
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in got.collect()) == sorted(want)
    # the hot id's rows are dealt over several tasks
    assert got.rdd.glom().map(len).filter(lambda n: n > 20).count() >= 3


def test_edits_of_one_and_none(spark):
    one = spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")
    r = minhash.fingerprint_edits(one).collect()
    assert len(r) == 1 and r[0]["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest()
    assert minhash.fingerprint_edits(one.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "abcdef"), (5, "xyzxyz"), (None, "abcdef")], "doc_id long, text string")
    assert minhash.fingerprint_edits(nulls).count() == 3


def test_word_hashes_are_taken_from_bytes():
    import pyarrow as pa

    found = pa.array(["x", "", "größe", "word", "a" * 90, "ab"])
    for part in (found, found.slice(2, 3), found.slice(6)):
        assert minhash._Hashes()(part).tolist() == [xxhash.xxh64_intdigest(w, 42) for w in part.to_pylist()]


def test_classes_are_named_without_reading_texts_again(spark, sf_dir):
    found = minhash.near_duplicates(read(spark, sf_dir, "documents"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" not in plan and "parquet" not in plan and found.count() == read(spark, sf_dir, "documents").count()


def test_minhash_near_duplicates(spark):
    rows = edits(11)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(df).collect()}
    texts = dict(rows)
    assert got == classes(sorted(texts), lambda a, b: jaccard(texts[a], texts[b], 5) >= 0.8)


def test_minhash_shared_passage(spark):
    """Pairs over 0.8 whose buckets also hold relatives under 0.8 with lesser ids."""
    pick = random.Random(31)
    some = lambda n: ["".join(pick.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    shared = some(204)
    rows = [(i, " ".join(shared + some(30))) for i in range(100)]
    for i in range(100, 180, 2):
        start = shared + some(7)
        rows += [(i, " ".join(start + some(23))), (i + 1, " ".join(start + some(23)))]
    rows += [(300, None), (301, " "), (302, rows[100][1]), (None, rows[102][1]), (None, "no other like this")]
    texts = {i: t for i, t in rows if i is not None}
    assert all(0.8 <= jaccard(texts[i], texts[i + 1], 5) < 0.83 and jaccard(texts[0], texts[i], 5) < 0.78 for i in range(100, 180, 2))
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, class_id int")
    found = minhash.near_duplicates(df).collect()
    got = {r["doc_id"]: r["class_id"] for r in found if r["doc_id"] is not None}
    assert sorted(str(r["class_id"]) for r in found if r["doc_id"] is None) == ["102", "None"]
    assert minhash.near_duplicates(df.limit(0)).count() == 0
    assert got == {**{i: i for i in range(100)}, **{i: i - i % 2 for i in range(100, 180)}, 300: 300, 301: 300, 302: 100}


def test_deduplicated_keys(spark):
    """Rows without an id are compared, and rows that share an id but not a text are different documents."""
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(None, base), (7, base + " x"), (None, base), (8, "one text"), (8, "another text"), (8, "one text"), (None, "alone"), (None, "alone"), (None, None), (9, "")]
    df = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    got = sorted((str(r["doc_id"]), r["text"]) for r in simhash.deduplicated(df).collect())
    assert got == sorted([("7", base + " x"), ("8", "one text"), ("8", "another text"), ("None", "alone"), ("9", "")])


def test_a_family_of_near_copies_is_dealt_once(spark):
    """Texts that differ in one word of 200: rows dealt for each text don't grow with the family."""
    base = [f"word{k}" for k in range(200)]
    rows = [(i, " ".join([*base[: i % 200], f"own{i}", *base[i % 200 + 1 :]])) for i in range(900)]
    prints = minhash.checkpointed(minhash.fingerprints(spark.createDataFrame(rows, "node long, text string"), "node"))
    bands = prints.select("node", "fingerprint", F.explode("bands").alias("bucket"))
    sizes = bands.groupBy("bucket").count().where("count > 256").select("bucket", minhash.parts_of("count", minhash.MOST).alias("parts"))
    crowded = bands.join(sizes, "bucket")
    found, left = minhash._pivoted(crowded, 0.8)
    n = crowded.count()
    assert n > 900 and sum(x.count() for x in found) <= n and sum(x.count() for x in left) < n // 10
    root = {r["node"]: r["root"] for r in components.connected_components(minhash.links(prints)).collect()}
    assert len(root) == 900 and len(set(root.values())) == 1


@pytest.mark.parametrize("kind, make", [("string", lambda i: f"id {i:04d}"), ("decimal(12,1)", lambda i: decimal.Decimal(f"{i}.5"))])
def test_ids_of_other_types(spark, kind, make):
    rows = [(i, t) for i, t in edits(13)[:50]]
    named = [(make(i), t) for i, t in rows] + [(None, "none")]
    df = spark.createDataFrame(named, f"doc_id {kind}, text string").repartition(3)
    texts = dict(rows)
    want = {make(i): make(j) for i, j in classes(sorted(texts), lambda a, b: jaccard(texts[a], texts[b], 5) >= 0.8).items()}
    assert {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(df).collect() if r["doc_id"] is not None} == want
    assert sorted(str(r["doc_id"]) for r in simhash.deduplicated(df).collect()) == sorted([*map(str, set(want.values())), "None"])
    order = sorted(named[:-1], key=lambda r: r[0], reverse=True) + named[-1:]
    edit = lambda t, f: hashlib.sha256((t[: len(t) - len(t) // 3] + f[: len(t) // 3]).encode()).hexdigest()
    got = {r["doc_id"]: r["edited_sha256"] for r in minhash.fingerprint_edits(df).collect()}
    assert got == {i: edit(t or "", f or "") for (i, t), (_, f) in zip(order, [*order[1:], order[0]], strict=True)}


def test_edits_of_a_row_repeated_very_often(spark):
    rows = spark.createDataFrame([(3, "before it"), (1, "after it, as ids fall"), (None, "last")], "doc_id long, text string")
    many = spark.range(100_000).select(F.lit(2).cast("long").alias("doc_id"), F.lit("the same text again").alias("text"))
    got = minhash.fingerprint_edits(rows.unionByName(many)).groupBy("doc_id", "edited_sha256", "near_next").count().collect()
    edit = lambda t, f: hashlib.sha256((t[: len(t) - len(t) // 3] + f[: len(t) // 3]).encode()).hexdigest()
    text = "the same text again"
    assert {(r["doc_id"], r["edited_sha256"]): r["count"] for r in got} == {
        (3, edit("before it", text)): 1, (2, edit(text, text)): 99_999, (2, edit(text, "after it, as ids fall")): 1, (1, edit("after it, as ids fall", "last")): 1, (None, edit("last", "before it")): 1,
    }
    assert {r["near_next"] for r in got if r["count"] > 1} == {1.0}
