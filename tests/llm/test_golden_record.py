"""Golden records against a plain version and against SQL."""

import datetime as dt
import math
import random
from collections import defaultdict

import pytest

from lodestone.llm import golden_record, queries
from tests.conftest import same_rows

SCHEMA = "client_id {id}, master_id {id}, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double, n_stale string, cluster_latest int"
FIELDS = ["cluster_id", "n_records", "n_stale", "name", "email", "segment", "city", "nation_id", "balance_cents", "name_from", "email_from", "segment_from", "balance_from", "address_from"]
BASE = dt.datetime(2024, 3, 1)


def plain(rows):
    """``rows``: tuples of the first ten columns."""
    trust = {s: k for k, s in enumerate(golden_record.TRUST)}
    last = lambda v: (v is None, v)
    clusters = defaultdict(list)
    for client, master, source, at, name, email, city, nation, segment, balance in rows:
        text = [None if t is None or not t.strip(" \t\n\v\f\r") else t for t in (name, email, city, segment)]
        cents = math.floor(100 * balance + 0.5) if balance is not None and math.isfinite(balance) else None
        clusters[client if master is None else master].append((client, trust.get(source, 4), at, *text[:3], nation, text[3], cents))
    out = {}
    for cluster, own in clusters.items():
        times = [r[2] for r in own if r[2] is not None]
        stale = lambda r: r[2] is None or r[2] < max(times) - dt.timedelta(hours=240)  # noqa: B023, E731
        values = lambda r: tuple(map(last, (r[7], r[3], r[4], r[5], r[6], r[8])))
        recent = lambda r: (r[2] is None, BASE - (r[2] or BASE), r[1], last(r[0]), values(r))
        trusted = lambda r: (stale(r), r[1], recent(r))  # noqa: B023, E731
        pick = lambda k, order: next(((r[k], r[0]) for r in sorted(own, key=order) if r[k] is not None), (None, None))  # noqa: B023, E731
        segment = pick(7, recent)
        balance = pick(8, lambda r: (r[7] != segment[0], recent(r)))  # noqa: B023
        name = pick(3, lambda r: (-len(r[3] or ""), trusted(r)))
        email = pick(4, trusted)
        place = min(own, key=lambda r: ((r[5] is None) + (r[6] is None), recent(r)))
        out[cluster] = (cluster, len(own), sum(map(stale, own)), name[0], email[0], segment[0], place[5], place[6], balance[0], name[1], email[1], segment[1], balance[1], place[0] if (place[5], place[6]) != (None, None) else None)
    return out


def hostile(n, ids, seed=7):
    pick = random.Random(seed)
    times = [None, *(BASE - dt.timedelta(hours=h) for h in (0, 1, 240, 239, 241, 480)), BASE - dt.timedelta(hours=240, microseconds=1), BASE - dt.timedelta(hours=239, minutes=59, seconds=59, microseconds=999999)]
    texts = [None, "", " \t\n", " a ", "é🙂", "abc", "\xa0", "long enough"]
    rows = []
    for k in range(n):
        rows.append((ids(k), ids(pick.choice([0, 0, 0, 1, 2, 3, k])) if pick.random() < 0.8 else None, pick.choice([*golden_record.TRUST, None, "other", " store"]), pick.choice(times), *(pick.choice(texts) for _ in range(3)), pick.choice([None, 1, 2]), pick.choice([None, "", "x", "y", "z"]), pick.choice([None, 1.005, -2.675, 0.0, 12345678.905, float("nan"), float("inf")])))
    rows += [rows[0]] * 3 + [(None, None, *rows[1][2:]), (None, ids(1), *rows[2][2:])]
    pick.shuffle(rows)
    return rows


def result(df):
    found = [tuple(r[c] for c in FIELDS) for r in df.collect()]
    assert len(found) == len({r[0] for r in found})
    return {r[0]: r for r in found}


def table(spark, rows, kind="long"):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA.format(id=kind))


@pytest.mark.parametrize("parts", [1, 7])
def test_against_plain(spark, parts):
    rows = hostile(600, int)
    assert result(golden_record.golden(table(spark, rows).repartition(parts))) == plain(rows)


def test_small_blocks_and_crowded_clusters(spark, monkeypatch):
    # tasks run in workers that fork from here: many blocks, all of them crowded, and groups of a few rows
    monkeypatch.setattr(golden_record, "CROWDED", 2)
    monkeypatch.setattr(golden_record, "GROUP", 20)
    rows = hostile(900, int, 11)
    assert result(golden_record.golden(table(spark, rows).repartition(40))) == plain(rows)


def test_large_ids_and_text_ids(spark):
    big = 2**60
    rows = hostile(200, lambda k: big + k)
    assert result(golden_record.golden(table(spark, rows))) == plain(rows)
    rows = hostile(200, lambda k: f"id{k:05d}")
    assert result(golden_record.golden(table(spark, rows, "string"))) == plain(rows)


def test_one_cluster_with_most_rows(spark):
    pick = random.Random(5)
    rows = [(k, 7 if k % 3 else None, pick.choice(golden_record.TRUST), BASE - dt.timedelta(seconds=pick.randrange(40 * 86400)), f"n{k % 50}", None, "c", k % 5, pick.choice("abc"), k / 7) for k in range(6000)]
    got = golden_record.prune(golden_record._records(table(spark, rows).repartition(4)))
    of_it = got.where("cluster_id = 7")
    assert of_it.count() <= 4 * (1 + 5 + 5 + 4 + 1)  # slots of four blocks
    assert result(golden_record.golden(table(spark, rows).repartition(4))) == plain(rows)


def test_empty(spark):
    assert golden_record.golden(table(spark, [(1, 1, "web", BASE, "a", "b", "c", 1, "s", 1.0)]).where("false")).collect() == []


def test_query(spark, sf_dir, duck):
    duck.execute(f"create or replace view clients as select * from '{sf_dir}/clients.parquet'")
    same_rows(queries.QUERIES["op13_golden_record"](spark, sf_dir), duck.execute(queries.ORACLES["op13_golden_record"]))
