"""The field's base matches against the plain patterns, its decoding against all segmentations, and its training on held-out spellings."""

import hashlib
import itertools
import random
import re

import pytest

from lodestone.llm import pii, queries
from lodestone.llm._common import read

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def plain(text):
    found = []
    for k, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            fits = (True, all(len(p) < 4000 and int(p) <= 255 for p in m[0].split(".")) if k == 1 else True, 16 <= len(digits) <= 19 and luhn(digits), 8 <= len(digits) <= 15)[k]
            if fits:
                found.append((k, m.start(), m.end()))
    return found


def hostile(n=3000):
    pick = random.Random(9)
    parts = ["a", "B7", "@", ".", "..", "-", "+", "%", " ", "  ", "1", "12", "255", "256", "1.2.3.4", "x@y.z", "+1 (5", "4111 1111 1111 1111", "4111-1111-1111-1112", ")", "(", "é", "🙂", "\n", "x@y.z@w.v", "٣", "(at)", " at b dot c "]
    return ["".join(pick.choice(parts) for _ in range(pick.randint(0, 14))) for _ in range(n)]


SPECIAL = ["", "a" * 5000 + "@", "1" * 20_000, "+" * 3000, "1.2.3.4.5", "a@b.c%x@d.e", "a@@b.c", "@b.c", "00001.2.3.4", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "+1" + " (" * 4000, "9" * 15 + "-9", "1.2.3." + "9" * 5000]


def test_base_spans():
    for text in [*hostile(), *SPECIAL[:3], *SPECIAL[4:]]:
        assert pii.base_spans(text) == plain(text), text[:80]


@pytest.fixture(scope="module")
def trained(spark, sf_dir):
    return pii.learn(read(spark, sf_dir, "documents"))


def test_decode_is_the_best_of_all_segmentations(trained):
    def total(text, chosen, base):
        last, out = 4, 0.0
        for k, s, e in sorted(chosen, key=lambda x: x[2]):
            out += trained.after[last][k] + (1e6 if (k, s, e) in base else trained.score(text, s, e)[k] - 1.5)
            last = k
        return out

    apart = lambda chosen: all(a[2] <= b[1] for a, b in itertools.pairwise(sorted(chosen, key=lambda x: (x[1], x[2]))))
    several = 0
    for text in ["tel 899-555-1234 5551", "card 3782 822463 10005 or +1 (555) 123-4567", "bob dot x at mail dot example dot org, 10.1.2.3", "1 (820) 674-5459 8999", "x@y.z 4111 1111 1111 1111"]:
        base = pii.base_spans(text)
        options = [(k, s, e) for s, e, kinds in pii.candidates(text) for k in kinds if all(e <= b or s >= c for _, b, c in base)] + base
        best = max((c for n in range(4) for c in itertools.combinations(options, n) if apart(c)), key=lambda c: total(text, c, base))
        got = trained.decode(text, base)
        assert total(text, got, base) == pytest.approx(total(text, best, base))
        several += len(options) > 2
    assert several


def test_training_raises_the_likelihood_of_held_out_spellings(trained):
    hit = missed = wrong = 0
    for text, gold in pii.examples([], seed=77, made=800):
        got = set(trained.spans(text, pii.base_spans(text)))
        hit, missed = hit + len(got & set(gold)), missed + len(set(gold) - got)
        wrong += len({x for x in got - set(gold) if x not in pii.base_spans(text)})
    assert hit / (hit + missed) > 0.9 and wrong <= 8
    for text in ["on 2024-01-05 12:30", "version 1.2.3.4567", "ISBN 978-3-16-148410-0", "order 5551234567", "serial 1234567890123456", "look at example.com", "plain words only"]:
        assert trained.spans(text, pii.base_spans(text)) == []


def test_base_matches_stay(trained):
    for text in hostile(1500):
        base = pii.base_spans(text)
        spans = trained.spans(text, base)
        assert set(base) <= set(spans)
        added = sorted((s, e) for x in spans if x not in base for _, s, e in [x])
        assert all(a[1] <= b[0] for a, b in itertools.pairwise(added))
        assert all(e <= b or s >= c for s, e in added for _, b, c in base)


def test_find_on_special_rows(spark, trained):
    texts = [None, *SPECIAL, "mail bob (at) example (dot) com", "twice a@b.c", "twice a@b.c", "word " * 50_000 + "a@b.c"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(None, "a@b.c", "x")], "doc_id long, text string, spans string").repartition(3)
    rows = {r["doc_id"]: r for r in pii.find(df, trained).collect()}
    assert len(rows) == len(texts) + 1
    for i, t in enumerate(texts):
        assert [(pii.KINDS.index(x["kind"]), x["start"], x["end"]) for x in rows[i]["base"]] == (plain(t) if t is None or len(t) < 10_000 else pii.base_spans(t))
    assert [x["kind"] for x in rows[len(SPECIAL) + 1]["spans"]] == ["email"] and not rows[len(SPECIAL) + 1]["base"]
    assert pii.find(df.where("false"), trained).collect() == []
    assert pii.learn(df.where("false")).weights


def test_query(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in read(spark, sf_dir, "documents").collect()}
    rows = queries.QUERIES["op12_pii_semi_markov"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in base) for k in range(4)]
        written = [f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(written).encode()).hexdigest()
        assert set(written) <= set(r["spans"].split(","))
