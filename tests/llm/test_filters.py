"""URL reputation, quality rules, classifier, toxicity and licences."""

import math
import random
import re
import zlib

import numpy as np
import pytest

from lodestone.llm import license_scan, quality_classifier, quality_rules, queries, toxicity, url_reputation
from tests.conftest import same_rows

TEXTS = [
    None, "", " \n ", "one two three", "a b c d e f g h " * 6, "x#y $1 %% &<|>* ok", "same line\nsame line\n\n \nother", "\x0bone\x0ctwo\rthree\x1cfour\x85five", "wörd 字 " * 30,
    "Released under the MIT License.", "under\nthe MIT license, under the mit license", "Apache License, Version 2.0; CC BY-NC 4.0", "This work is licensed under the GNU General Public License, version 3.",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
    "gnu public general license version", "w " * 5000,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [*((i, t) for i, t in enumerate(TEXTS)), (50, "twice"), (50, "twice"), (None, "no id")]
    return rows, spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, 7) for i, t in rows], "doc_id long, text string, lang string, n_words int")


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_oracles(spark, sf_dir, duck, name):
    same_rows(queries.QUERIES[name](spark, sf_dir), duck.execute(queries.ORACLES[name]))


def test_url_cases(spark):
    urls = [
        (1, "https://A.Example.COM/de/x?q"), (2, "http://example.net"), (3, "http://example.net/en/1"), (4, "http://badexample.net/en/"), (5, None), (6, "no scheme/here"), (7, "x://h.org/fr/#f"), (8, "ftp://net?/en/"),
        (9, "http://s.spam.biz/1"), (10, "http://t.spam.biz/1"), (11, "a://b://c/d"), (None, "http://ok.org/"), (3, "http://example.net/en/1"),
    ]
    pages = spark.createDataFrame([(i, u, "x") for i, u in urls], "page_id long, url string, good string")
    bad = spark.createDataFrame([(100 + k, f"http://s.spam.biz/{k}", "x") for k in range(60)], "page_id long, url string, good string")
    fine = spark.createDataFrame([(200 + k, f"http://w{k % 7}.fine.org/{k}", "x") for k in range(60)], "page_id long, url string, good string")
    outcomes = spark.createDataFrame([*((100 + k, 0) for k in range(60)), *((200 + k, 1) for k in range(60)), (None, 1), (1, None)], "page_id long, good int")
    got = {r["page_id"]: r for r in url_reputation.judge(pages.union(bad).union(fine), outcomes).collect()}
    assert (got[1]["host"], got[1]["path"], got[1]["rule"], got[1]["verdict"]) == ("a.example.com", "/de/x", "example.com/de/", "block")
    assert (got[2]["path"], got[2]["rule"]) == ("", None)
    assert (got[3]["rule"], got[3]["verdict"]) == ("example.net/en/", "allow")
    assert got[4]["rule"] == "net/"
    assert (got[5]["host"], got[5]["path"], got[6]["host"]) == ("", "", "")
    assert (got[7]["rule"], got[8]["host"], got[8]["path"]) == ("org/fr/", "net", "")
    assert got[9]["verdict"] == "block" and got[200]["verdict"] == "allow"
    assert got[10]["posterior_mean"] < 0.5 < got[200]["posterior_mean"]  # a host without labels of its own takes its domain's
    assert (got[11]["host"], got[11]["path"]) == ("b:", "//c/d")
    assert all(0 < r["posterior_mean"] < 1 and r["posterior_mean"] <= r["posterior_upper"] <= 1 for r in got.values())
    empty = spark.createDataFrame([], "page_id long, good int")
    assert {r["verdict"] for r in url_reputation.judge(pages.where("page_id in (5, 9, 10)"), empty).collect()} == {"allow"}
    assert url_reputation.judge(pages.limit(0), empty).count() == 0


def beta_upper(a, b, q):
    """The quantile from sums of the density over a fine even grid of log odds."""
    t = np.linspace(np.log(a / b) - 60 / min(a, 1) - 8, np.log(a / b) + 60 / min(b, 1) + 8, 4_000_001)
    level = a * t - (a + b) * np.logaddexp(0, t)
    total = np.cumsum(np.exp(level - level.max()))
    return 1 / (1 + np.exp(-t[np.searchsorted(total, q * total[-1])]))


def test_beta_quantile(spark):
    pairs = [(0.02, 1.98), (0.5, 0.5), (1.0, 1.0), (2.0, 3.0), (1.9, 0.1), (40.0, 2.0), (850.0, 150.0), (3.0, 900.0), (90000.0, 10000.0)]
    got = {(r["a"], r["b"]): r["quantile"] for r in url_reputation.beta_quantile(spark.createDataFrame(pairs, "a double, b double")).collect()}
    for a, b in pairs:
        assert got[a, b] == pytest.approx(beta_upper(a, b, 0.95), abs=2e-3), (a, b)
    assert got[1.0, 1.0] == pytest.approx(0.95, abs=1e-3)  # even


def test_domains(spark):
    hosts = ["a.b.example.com", "x.shop.co.za", "me.github.io", "github.io", "u:p@www.Example.org:8080".lower(), "10.0.0.1:80", "[::1]:443", "host", "", "a.com.", "www.gov.uk", "b.or.jp"]
    own = url_reputation.bare(url_reputation.F.col("h"))
    rows = spark.createDataFrame([(h,) for h in hosts], "h string").select("h", url_reputation.domain_of(own).alias("d"), url_reputation.suffix_of(own).alias("s")).collect()
    assert {r["h"]: (r["d"], r["s"]) for r in rows} == {
        "a.b.example.com": ("example.com", "com"), "x.shop.co.za": ("shop.co.za", "co.za"), "me.github.io": ("me.github.io", "github.io"), "github.io": ("github.io", "github.io"), "u:p@www.example.org:8080": ("example.org", "org"),
        "10.0.0.1:80": ("10.0.0.1", "(address)"), "[::1]:443": ("[::1]", "(address)"), "host": ("host", "host"), "": ("", ""), "a.com.": ("a.com", "com"), "www.gov.uk": ("www.gov.uk", "gov.uk"), "b.or.jp": ("b.or.jp", "or.jp"),
    }


def test_planted_hosts(spark):
    """Hosts of bad pages are blocked, and with enough of them their domain's other hosts; one bad page is no proof."""
    rows = [(f"h{k}.fine{k % 9}.org", 1) for k in range(900)] + [(f"h{k}.fine{k % 9}.org", 0) for k in range(100)]
    rows += [("bad.mixed.org", 0)] * 60 + [("good.mixed.org", 1)] * 60 + [(f"s{k % 6}.spam.biz", 0) for k in range(240)] + [("once.lone.org", 0)]
    rows += [("new.spam.biz", None), ("new.mixed.org", None), ("new.other.org", None)]
    pages = spark.createDataFrame([(i, f"http://{h}/p") for i, (h, _) in enumerate(rows)], "page_id long, url string")
    outcomes = spark.createDataFrame([(i, g) for i, (_, g) in enumerate(rows) if g is not None], "page_id long, good int")
    got = {r["host"]: r["verdict"] for r in url_reputation.judge(pages, outcomes).collect()}
    blocked = {h for h, v in got.items() if v == "block"}
    assert blocked == {"bad.mixed.org", "new.spam.biz", *(f"s{k}.spam.biz" for k in range(6))}


def brute_measures(text):
    text = text or ""
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = {}
    for i in range(len(found) - 7):
        windows.setdefault(tuple(found[i : i + 8]), []).append(i)
    covered = {i + k for own in windows.values() if len(own) > 1 for i in own for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_measures(docs):
    rows, df = docs
    got = quality_rules.measures(df).collect()
    assert sorted(str((r["doc_id"], *(r[m] for m in quality_rules.MEASURES[:5]))) for r in got) == sorted(str((i, *brute_measures(t))) for i, t in rows)


def test_measures_of_many_words():
    pick = np.random.default_rng(4)
    import pyarrow as pa

    texts = [" ".join(pick.choice(list("abc"), n)) for n in (0, 5, 8, 9, 30, 400, 3000)]
    codes, at, _ = quality_rules.words(pa.array(texts))
    assert quality_rules.repeated(codes, at).tolist() == [brute_measures(t)[4] for t in texts]


def test_certified_cutoffs():
    assert quality_rules.tail(300, 0, 0.01) == pytest.approx(0.99**300)
    assert quality_rules.tail(50, 50, 0.3) == pytest.approx(1)
    none = tuple(len(grid) for _, grid in quality_rules.RULES.values())
    some = lambda k: (*none[:2], k, *none[3:])  # noqa: E731  over the cutoffs of "repeats" from place k on
    steps = quality_rules.order_of([none, some(2)], [500, 3])
    assert [x for x in steps if x[0] == "repeats"] == [("repeats", k) for k in range(6)] and steps[-1] == ("repeats", 5)
    assert quality_rules.certified(steps, [none], [2000], 0.01) == {rule: len(grid) - 1 for rule, (_, grid) in quality_rules.RULES.items()}
    assert quality_rules.certified(steps, [none], [50], 0.01) == {}  # too few labels certify nothing
    assert quality_rules.certified(steps, [none, some(3)], [2000, 40], 0.01)["repeats"] == 2
    assert quality_rules.certified(steps[::-1], [none, some(5)], [1000, 500], 0.01) == {}  # testing stops at the first failure


def test_rules_keep_good_texts(spark):
    good = [(i, " ".join(f"word{(i * 7 + k) % 97}" for k in range(40)), "en") for i in range(1500)]
    bad = [(5000 + i, " ".join(f"w{k + i}%%%###" for k in range(40)), "en") for i in range(50)]
    df = spark.createDataFrame([*good, *bad, (9000, "short", None)], "doc_id long, text string, lang string")
    labelled = spark.createDataFrame([(i,) for i, _, _ in good[:1200]], "doc_id long")
    got = {r["doc_id"]: r for r in quality_rules.judge(df, labelled).collect()}
    assert all(got[i]["kept"] for i, _, _ in good)
    assert not any(got[i]["kept"] for i, _, _ in bad)
    assert got[9000]["base_failed"] and not got[9000]["kept"]
    none = labelled.limit(0)
    assert all(r["kept"] != r["base_failed"] for r in quality_rules.judge(df, none).collect())
    assert quality_rules.judge(df.limit(0), none).count() == 0


def brute_kept(rows, good, risk=0.01, confidence=0.95):
    """Verdicts by the definition, row by row: rows are (id, text, stratum)."""
    import hashlib
    from math import comb

    rules = quality_rules.RULES

    def values(text):
        found = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, chars, symbols, dups, repeats = brute_measures(text)
        lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in (text or "").split("\n"))
        words_ = max(1, len(found))
        return {"symbols": 100 * symbols / words_, "duplicate_lines": 100 * dups / max(1, lines), "repeats": 100 * repeats / words_, "long_words": chars / words_, "bangs": 100 * (text or "").count("!") / words_}, n < 20 or 100 * repeats > 30 * n

    seen = [(i, s, *values(t)) for i, t, s in rows]
    labelled = [x for x in seen if x[0] in good and not x[3]]
    strata = {x[1] for x in labelled}
    half = lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[0] >= "8")
    cut = {}
    for s in strata:
        first, second = ([x[2] for x in labelled if x[1] == s and half(x[0]) == h] for h in (0, 1))
        steps = sorted((sum(v[rule] > c for v in first), k, rule, c) for rule, (_, grid) in rules.items() for k, c in enumerate(grid))
        own = {}
        for _, _, rule, c in steps:
            tried = own | {rule: c}
            away, n = sum(any(v[r] > x for r, x in tried.items()) for v in second), len(second)
            if not n or away > risk * n or sum(comb(n, j) * risk**j * (1 - risk) ** (n - j) for j in range(away + 1)) > (1 - confidence) / len(strata):
                break
            own = tried
        cut[s] = own
    return {x[0]: not x[3] and not any(x[2][r] > c for r, c in cut.get(x[1], {}).items()) for x in seen}


def test_kept_by_definition(spark):
    pick = np.random.default_rng(12)
    rows = []
    for s, n in (("a", 2400), ("*", 2200), (None, 300), ("c", 30)):
        for i in range(n):
            ws = [f"w{pick.integers(900)}" + "#" * int(pick.random() < 0.002 * (s == "a")) + "!" * int(pick.random() < 0.01) for _ in range(pick.integers(15, 60))]
            if pick.random() < 0.02:
                ws += ws[:9] * int(pick.integers(1, 3))
            if pick.random() < 0.01:
                ws = [w * 6 for w in ws]
            rows.append((len(rows), ("\n" if pick.random() < 0.3 else " ").join(ws), s))
    good = {i for i, _, _ in rows if pick.random() < 0.9}
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["kept"] for r in quality_rules.judge(df, spark.createDataFrame([(i,) for i in good], "doc_id long")).collect()}
    want = brute_kept(rows, good)
    assert got == want
    base = {i for i, t, _ in rows if brute_measures(t)[0] >= 20 and 100 * brute_measures(t)[4] <= 30 * brute_measures(t)[0]}
    for s in ("a", "*"):  # the joint verdict keeps its promise
        own = [i for i, _, x in rows if x == s and i in good and i in base]
        assert sum(not got[i] for i in own) <= 0.01 * len(own)
    assert any(not got[i] for i in base)  # and does turn texts away


def test_rules_of_strata(spark):
    """Strata beyond 200 are certified too, and those without labels have the base rules only."""
    text = lambda i, w: " ".join(f"{w}{(i * 7 + k) % 97}" for k in range(30))
    rows = [(s * 1000 + i, text(i, "word"), f"s{s}") for s in range(205) for i in range(30)]
    many = [(10**6 + i, text(i, "word"), "many") for i in range(3000)]
    long = [(2 * 10**6 + i, text(i, "x" * 45), "unlabelled") for i in range(20)] + [(3 * 10**6, text(0, "x" * 45), "many")]
    df = spark.createDataFrame([*rows, *many, *long], "doc_id long, text string, lang string")
    good = spark.createDataFrame([(i,) for i, _, _ in [*rows, *many]], "doc_id long")
    got = {r["doc_id"]: r["kept"] for r in quality_rules.judge(df, good).collect()}
    assert all(got[i] for i, _, _ in [*rows, *many, *long[:20]])
    assert not got[3 * 10**6]
    measured = quality_rules.measures(df).withColumn("base_failed", quality_rules.F.lit(False))
    assert quality_rules.cutoffs(measured, good).count() == 206


def auc(score, label):
    order = np.argsort(score)
    rank = np.empty(len(order))
    rank[order] = np.arange(len(order))
    label = np.array(label)
    return (rank[label == 1].mean() - ((label == 1).sum() - 1) / 2) / (label == 0).sum()


@pytest.fixture(scope="module")
def large():
    return "/root/testdata/sf0.1"


def held_out(spark, rows, large, label):
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{large}/labels.parquet").collect()}
    own = [(r["score"], labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    return zip(*own, strict=True)


def test_quality_held_out(spark, large):
    rows = queries.op8_quality_ftrl(spark, large).collect()
    score, label, predicted = held_out(spark, rows, large, "quality")
    assert auc(score, label) > 0.98
    assert np.mean(np.array(predicted) == np.array(label)) > 0.97
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)


def test_toxicity_held_out(spark, large):
    rows = queries.op5_toxicity_lexicon(spark, large).collect()
    score, label, predicted = held_out(spark, rows, large, "toxic")
    assert auc(score, label) > 0.9
    assert np.mean(np.array(predicted) == np.array(label)) > 0.96
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)


def test_classifiers_without_labels(docs, spark):
    rows, df = docs
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for classify in (quality_classifier.classify, toxicity.classify):
        got = classify(df, none).collect()
        assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
        assert classify(df.limit(0), none).count() == 0
    odd = spark.createDataFrame([(1, None, None), (None, 1, 1), (3, 0, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    for classify in (quality_classifier.classify, toxicity.classify):
        assert classify(df, odd).count() == len(rows)


def test_folding_and_exceptions():
    found = toxicity.automaton({"idiot": 4.0, "trash": 2.0})
    score = lambda t: toxicity.evidence(found, toxicity.fold(t))
    for disguised in ("IDIOT", "1d10t", "іdіоt", "ｉｄｉｏｔ", "i\u200bdiot", "id!ot", "an idiot.", "ídïöt", "ÍDIÖT 字", "i\u0301diot", "ΙDΙΟΤ", "id|ot", "іdíοt"):
        assert score(disguised) == 4.0, disguised
    assert [toxicity.fold(t) for t in ("ΗΜΖ", "Ημζ", "ÀÉÎÕÜÇÑ", "ĀĒŁ字")] == ["hmz", "huz", "aeioucn", "aeł字"]
    assert score("idiotic") == 0 and score("trashy") == 0
    assert score("the trash can and trash") == 2.0
    assert all(score(f"the trash{gap}can and trash") == 2.0 for gap in ("\n", "  ", "-", "\t \r\n", " - ", "\u2011"))
    assert score("") == 0


def brute_evidence(lexicon, folded):
    """Whole-word hits outside whole-word exception phrases, place by place."""
    edge = lambda i, j: not (i and folded[i - 1].isalnum()) and not (j < len(folded) and folded[j].isalnum())
    places = lambda t: [(i, i + len(t)) for i in range(len(folded) - len(t) + 1) if folded.startswith(t, i) and edge(i, i + len(t))]
    spared = [x for e in toxicity.EXCEPTIONS for x in places(toxicity.fold(e))]
    return sum(w for t, w in lexicon.items() for i, j in places(t) if not any(a <= i and j <= b for a, b in spared))


def test_evidence():
    import time

    pick = np.random.default_rng(6)
    lexicon = {"trash": 2.0, "can": 0.5, "clown": 3.0, "class clown fish": 0.25, "scum": 1.5, "winner": 1.0}
    found = toxicity.automaton(lexicon)
    for _ in range(300):
        text = toxicity.fold(" ".join(pick.choice(["trash", "can", "class", "clown", "fish", "pond", "scum", "winner and loser", "winner", "xtrash", "bag", "."], pick.integers(0, 25))))
        assert toxicity.evidence(found, text) == pytest.approx(brute_evidence(lexicon, text)), text
    took = []
    for n in (4000, 16000):
        began = time.perf_counter()
        toxicity.evidence(found, "the trash can and trash " * n)
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0] + 0.1  # in proportion


def test_lexicon_by_definition(spark):
    import math

    pick = np.random.default_rng(16)
    common, vile = [f"w{k}" for k in range(60)], ["gr0ss", "vileness", "idiot", "meh"]
    texts = []
    for i in range(500):
        bad = i % 4 == 0
        ws = [*pick.choice(common, 15), *(pick.choice(vile, 2) if bad and pick.random() < 0.9 else []), *(["meh"] if pick.random() < 0.2 else [])]
        texts.append((i, " ".join(pick.permutation(ws)), int(bad)))
    df = spark.createDataFrame([(i, t) for i, t, _ in texts] + [(0, texts[0][1])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in texts], "doc_id long, toxic int")
    lexicon, curve = toxicity.learn(df, labels)
    left = {0: {}, 1: {}}
    for _, t, y in texts:
        found = re.findall(r"[^\W_]+", toxicity.fold(t))
        for before, w in zip(["", *found[:-1]], found, strict=True):
            left[y].setdefault(w, set()).add(before)
    n = [sum(y == k for _, _, y in texts) for k in (0, 1)]
    want = dict.fromkeys(toxicity.SEEDS, toxicity.SEED_WEIGHT)
    for w in {*left[0], *left[1]}:
        good, bad = (len(left[k].get(w, ())) + 0.5 for k in (0, 1))
        weight = math.log(bad / (n[1] + 1)) - math.log(good / (n[0] + 1))
        if w in toxicity.SEEDS or (bad - 0.5 >= toxicity.SUPPORT and weight - 2 * math.sqrt(1 / bad + 1 / good) > toxicity.ENTER and len(w) > 2):
            want[w] = weight
    want = {w: x for w, x in want.items() if x > 0}
    assert {"gross", "vileness"} <= set(want) and "meh" not in want
    assert lexicon == pytest.approx(want)
    rows = np.array([toxicity.shape(brute_evidence(want, toxicity.fold(t)), len(t.split())) for _, t, _ in texts])
    assert curve == pytest.approx(toxicity.fit(rows, np.array([float(y) for _, _, y in texts])))
    scored = {r["doc_id"]: r["score"] for r in toxicity.score(df, lexicon, curve).collect()}
    assert all(scored[i] == pytest.approx(1 / (1 + math.exp(-float(rows[i] @ np.array(curve))))) for i in range(500))
    assert set(toxicity.SEEDS) <= set(toxicity.learn(df, labels)[0])


def plain_ftrl(slots, values, labels, epochs, size):
    """FTRL-Proximal coordinate by coordinate, as published."""
    import math

    q = quality_classifier
    z, n = [0.0] * size, [0.0] * size
    weight = lambda i: 0.0 if abs(z[i]) <= q.L1 else -(z[i] - math.copysign(q.L1, z[i])) / ((q.BETA + math.sqrt(n[i])) / q.ALPHA + q.L2)
    order = np.random.default_rng(11)
    for _ in range(epochs):
        for r in order.permutation(len(labels)):
            row = [*zip(slots[r].tolist(), values[r].tolist(), strict=True), (size - 1, 1.0)]
            w = {i: weight(i) for i, _ in row}
            p = 1 / (1 + math.exp(-sum(w[i] * x for i, x in row)))
            for i, x in row:
                g = (p - labels[r]) * x
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / q.ALPHA
                z[i] += g - sigma * w[i]
                n[i] += g * g
    return {i: weight(i) for i in range(size) if weight(i)}


def test_ftrl_by_definition(spark):
    import pyarrow as pa

    pick = np.random.default_rng(13)
    texts = [" ".join(pick.choice(["good", "fine", "words", "BUY", "!!!!", "x1", "--==", "ok,", "ok,"], pick.integers(1, 30))) for _ in range(40)]
    labels = np.array([float("BUY" not in t) for t in texts])
    slots, values, at = quality_classifier.per_text(*quality_classifier.Featuriser()(pa.array(texts)))
    cut = lambda x: [x[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    got = quality_classifier.learn(cut(slots), cut(values), labels)
    want = plain_ftrl(cut(slots), cut(values), labels, quality_classifier.EPOCHS, (1 << quality_classifier.BITS) + 1)
    assert {i: got[i] for i in np.flatnonzero(got).tolist()} == pytest.approx(want)
    # the table's weights are those of the same rows, one text for each id, and the score is the dot product
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (3, texts[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    weights = quality_classifier.train(df, spark.createDataFrame([(i, int(y)) for i, y in enumerate(labels)], "doc_id long, quality int"))
    order = sorted(range(len(texts)), key=str)
    close = lambda x: [v.astype(np.float32).astype(float) for v in cut(x)]
    assert weights == pytest.approx(quality_classifier.learn([cut(slots)[i] for i in order], [close(values)[i] for i in order], labels[order]))
    scored = {r["doc_id"]: r["score"] for r in quality_classifier.score(df, weights).collect()}
    for i in range(len(texts)):
        z = sum(weights[s] * v for s, v in zip(cut(slots)[i], cut(values)[i], strict=True)) + weights[-1]
        assert scored[i] == pytest.approx(1 / (1 + np.exp(-z)))


def test_sample_bounds(spark):
    """One text for each id, and no more bytes than the bound, whatever repeats or is long."""
    rows = [(i % 50, f"text {i} " + "x" * (3000 if i % 50 == 7 else 10)) for i in range(400)] + [(60, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(70)], "doc_id long, quality int")
    take = lambda most, size: quality_classifier.sample_texts(df, labels, "doc_id", "text", "quality", most, size).collect()
    whole = take(100, 10**6)
    assert sorted(r["labelled"] for r in whole) == [*range(50), 60] and {(r["labelled"], r["text"]) for r in whole} <= {(i, t or "") for i, t in rows}
    few = take(100, 500)
    assert sum(len(r["text"]) for r in few) <= 500 and 7 not in {r["labelled"] for r in few} and len(few) > 20
    assert len(take(10, 10**6)) <= 10


def brute_license(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    places, labels = [], set()
    for phrase, label in license_scan.PHRASES:
        ws = phrase.split()
        own = [i for i in range(len(found)) if found[i : i + len(ws)] == ws]
        places += own
        labels |= {label} if own else set()
    return len(found), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_license_base(docs):
    rows, df = docs
    got = license_scan.scan(df).collect()
    own = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]
    assert sorted(str(tuple(r[c] for c in own)) for r in got) == sorted(str((i, *brute_license(t))) for i, t in rows)
    assert license_scan.scan(df.limit(0)).count() == 0


def test_license_templates(spark):
    plain = [(i, f"plain words of no licence number {i}") for i in range(200)]
    df = spark.createDataFrame([*plain, *((1000 + i, t) for i, t in enumerate(TEXTS))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.scan(df).collect()}
    assert all(got[i]["labels"] == "" and got[i]["score"] == 0 for i in range(200))
    label = lambda part: got[1000 + next(i for i, t in enumerate(TEXTS) if t and part in t)]["labels"]
    assert label("GNU General") == "gpl-3"
    assert label("Permission is") == "mit"
    assert label("Released under") == "mit"
    assert label("gnu public general") == ""
    assert all(set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) for r in got.values())


INDEX = license_scan.Index()


def lacks(n):
    return n - math.ceil(0.8 * n)


def brute_labels(text, templates=license_scan.TEMPLATES, index=INDEX):
    """Labels and score from the meaning of templates, word by word: starts at which a posted word stands in its place."""
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    drift = license_scan.DRIFT
    verified = []
    for t, (label, template, key) in enumerate(templates):
        ws, ks = template.split(), key.split()
        before = next(i for i in range(len(ws)) if ws[i : i + len(ks)] == ks)
        others = [k.split() for other, _, k in templates if other != label]
        must = {w for o in others for w in ks if sum(x not in o for x in ks) <= lacks(len(ks)) and w not in o}
        near = lambda place: found[max(0, place - drift) : max(0, place + drift + 1)]
        for start in {i - place for k, place in index.posted.tolist() if k == t for i, w in enumerate(found) if w == ws[place]}:
            gone = [w for k, w in enumerate(ks) if w not in near(start + before + k)]
            share = sum(w in near(start + k) for k, w in enumerate(ws)) / len(ws)
            if len(gone) <= lacks(len(ks)) and not must & set(gone) and share >= license_scan.SHARE - 1e-9:
                verified.append((label, set(ks), start + before, share))
    labels, best = set(filter(None, brute_license(text)[4].split(","))), float(brute_license(text)[1] > 0)
    for label, ks, place, share in verified:
        if not any(other != label and ks < longer and abs(there - place) <= 2 * drift for other, longer, there, _ in verified):
            labels.add(label)
            best = max(best, share)
    return ",".join(sorted(labels)), best


@pytest.mark.parametrize("text, labels", [
    ("Permission is hereby also granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction", "mit"),
    ("Permission is granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction", "mit"),
    ("SPDX-License-Identifier: GPL-3.0-only", "gpl-3"), ("// SPDX-License-Identifier: MIT", "mit"), ("SPDX-License-Identifier: CC-BY-NC-4.0", "cc-by-nc"), ("licensed under the GNU GPL v3", "gpl-3"),
    ("the BSD 3-Clause license", "bsd"), ("licensed under CC BY 4.0", "cc-by"), ("licensed under the GNU Lesser General Public License", "lgpl"), ("This work is licensed under the GNU General Public License version 2", "gpl-2"),
    ("it is licensed to drive under the general terms of the public library, version 3 of the plan", ""), ("identifier of the mit building", ""),
])
def test_license_spellings(spark, text, labels):
    assert license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["labels"] == labels == brute_labels(text)[0]


def test_license_templates_from_a_table(spark):
    """600 made-up licences beside the known ones: the same labels for the known, and their own."""
    pick = random.Random(2)
    word = lambda: "".join(pick.choice("abcdefghijklmnop") for _ in range(6))
    made = [(f"own-{k}", " ".join(["This license", *(word() for _ in range(20)), "Permission, granted"])) for k in range(600)]
    table = spark.createDataFrame([(label, text, " ".join(text.split()[3:8])) for label, text in made], "label string, text string, key string")
    templates = [*license_scan.TEMPLATES, *license_scan.templates_of(table)]
    rows = [(0, TEXTS[3]), (1, "before. " + made[5][1] + " after"), (2, made[7][1].replace("This license", "This fine license")), (3, "plain")]
    got = {r["doc_id"]: r["labels"] for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), templates=templates).collect()}
    assert got == {0: brute_labels(TEXTS[3])[0], 1: "own-5", 2: "own-7", 3: ""}
    with pytest.raises(ValueError):
        license_scan.templates_of(spark.createDataFrame([("x", "some words", "other")], "label string, text string, key string"))


def altered(template, pick, n, drop):
    ws = template.split()
    for _ in range(min(n, len(ws) // 2)):
        at = pick.integers(len(ws))
        ws = ws[:at] + ws[at + 1 :] if drop else [*ws[:at], "inserted", *ws[at:]]
    return " ".join(ws)


@pytest.mark.parametrize("filler", [0, 300])
def test_license_labels(spark, filler):
    """Every template alone, altered, in pairs and all in one text; in tables of licences only, and among other texts."""
    pick = np.random.default_rng(8)
    whole = [t for _, t, _ in license_scan.TEMPLATES]
    texts = [*whole, " . ".join(whole), *TEXTS]
    texts += [f"{a}. {b}" for a, b in zip(whole, whole[1:] + whole[:1], strict=True)]
    texts += ["Some words. " + altered(t, pick, n, drop) + " and more." for t in whole for n in (1, 2, 4, 8) for drop in (False, True)]
    rows = [*enumerate(texts), *((10_000 + i, f"plain words under the number {i}") for i in range(filler))]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {i: brute_labels(t) for i, t in rows}
    assert {i: g[0] for i, g in got.items()} == {i: w[0] for i, w in want.items()}
    assert all(got[i][1] == pytest.approx(want[i][1]) for i in got)
    assert all(license_scan.TEMPLATES[i][0] in got[i][0].split(",") for i in range(len(whole)))
    assert set(got[len(whole)][0].split(",")) == {label for label, _, _ in license_scan.TEMPLATES}


def test_license_notice_with_a_word_more(spark):
    for _, t, key in license_scan.TEMPLATES:
        ws = t.split()
        if len(ws) >= 20 and t.startswith(key):
            changed = " ".join([*ws[:-3], "more", *ws[-3:]])
            assert brute_labels(changed)[0]
            assert license_scan.scan(spark.createDataFrame([(1, changed)], "doc_id long, text string")).first()["labels"] == brute_labels(changed)[0]


def test_license_of_many_files(spark):
    """Lines that most files have, and tables of few files."""
    line = "This work is licensed under the GNU General Public License, version 3."
    df = spark.createDataFrame([*((i, f"own words {i}. {line} more") for i in range(60)), *((100 + i, f"plain text {i}") for i in range(30))], "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in license_scan.scan(df).collect()}
    assert got == {i: "gpl-3" if i < 100 else "" for i in got}
    assert [r["labels"] for r in license_scan.scan(df.where("doc_id = 0")).collect()] == ["gpl-3"]


def test_license_of_many_notices(spark):
    """Every template and base phrase in one text, and a notice beside a line whose words are less rare."""
    notice = license_scan.TEMPLATES[0][1]
    line = "This work is licensed under the GNU General Public License version 3"
    rows = [*((i, f"plain words number {i}") for i in range(200)), (300, f"{notice}. {line}."), (301, " . ".join([t for _, t, _ in license_scan.TEMPLATES] + [p for p, _ in license_scan.PHRASES]))]
    got = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[300]["labels"] == "gpl-3,mit" and got[300]["score"] == 1
    assert set(got[301]["labels"].split(",")) == {label for label, _, _ in license_scan.TEMPLATES}
