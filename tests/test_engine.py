"""Operators of the engine: hand-computed cases and properties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.config import EngineConfig, normalised_ratios
from lodestone.functions import scalars
from lodestone.functions.vectors import Bank, average_of, squared_l2, squared_matrix, top_k
from lodestone.operators import coreset, features, ivf, knn, ordered, split, tuning


def vectors(spark, rows, id_col="bank_id"):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], f"{id_col} long, emb array<float>")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_half_even():
    assert [coreset.target(5, 0.5), coreset.target(7, 0.5), coreset.target(3, 0.01), coreset.target(4, 1.0)] == [2, 4, 1, 4]
    assert [ordered.p95_rank(n) for n in (1, 10, 20, 30)] == [0, 9, 18, 27]


def test_aggregate_and_downscale():
    assert features.neighbourhood_means(np.array([[[[1.0, 2], [3, 4]]]]), 3).reshape(-1).tolist() == [2.5] * 4
    assert features.neighbourhood_means(np.array([[[[0.0, 3, 9]]]]), 3).reshape(-1).tolist() == [1.5, 4, 6]
    assert features.block_means(np.array([[[[1.0, 2], [3, 4]]]]), 2).reshape(-1).tolist() == [2.5]
    with pytest.raises(ValueError):
        features.block_means(np.zeros((1, 1, 3, 3)), 2)
    even = features.neighbourhood_means(np.arange(16.0).reshape(1, 1, 4, 4), 2)
    assert np.array_equal(even, features.neighbourhood_means(np.arange(16.0).reshape(1, 1, 4, 4), 3))


def test_patches(spark):
    df = spark.createDataFrame([("a", [float(x) for x in range(8)])], "image_id string, data array<float>")
    got = features.patches(df, shape=(2, 2, 2)).orderBy("patch_idx").collect()
    assert [(r["y"], r["x"], list(r["emb"])) for r in got] == [(0, 0, [0, 4]), (0, 1, [1, 5]), (1, 0, [2, 6]), (1, 1, [3, 7])]
    with pytest.raises(Exception, match="values"):
        features.patches(df, shape=(2, 2, 3)).collect()
    short = spark.createDataFrame([("a", 0, 1.0)], "image_id string, patch_idx int, dist double")
    with pytest.raises(Exception, match="missing patches"):
        features.score_map(short, "image_id", 2, 2).collect()


def test_metrics(spark):
    near = F.array(F.lit(1.0), F.lit(4.0), F.lit(9.0))
    assert one(spark, average_of(near, "squared_euclidean")) == 2.0
    assert one(spark, average_of(near, "euclidean")) == pytest.approx(14 / 3)
    assert one(spark, average_of(F.array().cast("array<double>"), "euclidean")) == 0
    assert one(spark, squared_l2(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(4.0), F.lit(6.0)))) == 25


def test_small_bank(spark):
    near = knn.nearest(vectors(spark, [[0, 0]], "image_id"), ["image_id"], vectors(spark, [[2, 0], [0, 4]]), 9)
    assert [(r["rank"], r["bank_id"], r["d2"]) for r in near.orderBy("rank").collect()] == [(1, 0, 4.0), (2, 1, 16.0)]
    assert knn.averaged(near, ["image_id"], "squared_euclidean").first()["dist"] == 3.0
    none = vectors(spark, [[1, 1]]).limit(0)
    assert knn.nearest(vectors(spark, [[0, 0]], "image_id"), ["image_id"], none, 3).count() == 0


def test_ties_take_the_lower_id(spark):
    bank = vectors(spark, [[1, 0], [0, 1], [-1, 0], [0, -1], [1, 0]] * 3)
    for limit in (knn.BROADCAST_BYTES, 0):
        near = knn.nearest(vectors(spark, [[0, 0]], "image_id"), ["image_id"], bank, 4, limit=limit)
        assert [r["bank_id"] for r in near.orderBy("rank").collect()] == [0, 1, 2, 3]


def test_kernel_against_expression(spark):
    random = np.random.default_rng(1)
    a, b = random.normal(size=(20, 7)).astype(np.float32), random.normal(size=(30, 7)).astype(np.float32)
    rows = [(i, j, a[i].tolist(), b[j].tolist()) for i in range(20) for j in range(30)]
    got = {(r[0], r[1]): r[2] for r in spark.createDataFrame(rows, "i int, j int, a array<float>, b array<float>").select("i", "j", squared_l2(F.col("a"), F.col("b"))).collect()}
    want = squared_matrix(a, b)
    assert max(abs(got[i, j] - want[i, j]) for i, j in got) < 1e-9
    near, ids = top_k(want, np.arange(30), 5)
    order = np.argsort(want, axis=1, kind="stable")[:, :5]
    assert np.array_equal(ids, order) and np.array_equal(near, np.take_along_axis(want, order, axis=1))


def test_bank_against_all_distances(monkeypatch):
    """Neighbours by one product and exact distances, with ties, copies and vectors far from the origin."""
    monkeypatch.setattr(Bank, "MOST", 500)  # so that queries go in slabs
    random = np.random.default_rng(9)
    for bank, queries in (
        (random.normal(size=(120, 5)), random.normal(size=(33, 5))), (random.integers(0, 3, (200, 4)).astype(float), random.integers(0, 3, (40, 4)).astype(float)),
        (random.normal(size=(50, 3)) * 1e-3 + 1e4, random.normal(size=(20, 3)) * 1e-3 + 1e4), (np.ones((30, 2)), np.ones((3, 2))), (random.normal(size=(4, 2)), random.normal(size=(5, 2))),
    ):
        ids = np.arange(len(bank)) * 3
        near, found = Bank(bank, ids).nearest(queries, 7)
        want, want_ids = top_k(squared_matrix(queries, bank), ids, 7)
        assert np.array_equal(found, want_ids) and np.allclose(near, want, rtol=1e-12, atol=0)
    assert Bank(np.empty((0, 2)), np.empty(0, dtype=np.int64)).nearest(np.ones((2, 2)), 3)[0].shape == (2, 0)


def test_null_vectors(spark):
    """A query without a vector has no neighbours, a bank row without one is nobody's; other rows' answers don't change."""
    random = np.random.default_rng(19)
    points = random.normal(size=(60, 3))
    row = lambda i, v: (i, None if v is None else [float(x) for x in v])
    bank = spark.createDataFrame([row(i, v) for i, v in enumerate(points)] + [row(100, None), row(101, None)], "bank_id long, emb array<float>")
    whole = bank.where("emb is not null")
    queries = spark.createDataFrame([row(0, [1, 2, 3]), row(1, None), row(2, [0, 0, 0])], "image_id long, emb array<float>")
    asked = queries.where("emb is not null")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    for limit in (knn.BROADCAST_BYTES, 0):
        want = rows(knn.nearest(asked, ["image_id"], whole, 4, limit=limit))
        assert rows(knn.nearest(queries, ["image_id"], bank, 4, limit=limit)) == want and len(want) == 8
        index = ivf.build(bank, 5, limit=limit)
        assert rows(index[0].select("bank_id", "cluster_id")) == rows(ivf.build(whole, 5)[0].select("bank_id", "cluster_id"))
        got = rows(ivf.nearest_probed(queries, ["image_id"], *index, 4, 2, limit=limit))
        assert got == rows(ivf.nearest_probed(asked, ["image_id"], *ivf.build(whole, 5), 4, 2)) and len(got) == 8
        assert rows(coreset.sample(bank, 0.2, limit=limit).select("pick", "bank_id")) == rows(coreset.sample(whole, 0.2).select("pick", "bank_id"))
    assert rows(ivf.probes(queries, ["image_id"], index[1], 2).select("image_id", "probe")) == [(0, 1), (0, 2), (2, 1), (2, 2)]
    two = spark.createDataFrame([row(0, [1, 2]), row(1, None)], "image_id long, emb array<float>")
    near = knn.nearest(two, ["image_id"], spark.createDataFrame([row(5, [1, 2])], "bank_id long, emb array<float>"), 1).collect()
    assert [(r["image_id"], r["bank_id"], r["d2"]) for r in near] == [(0, 5, 0.0)]
    none = bank.where("bank_id >= 100")
    assert knn.nearest(queries, ["image_id"], none, 3).count() == 0 and coreset.sample(none, 0.5).count() == 0
    with pytest.raises(ValueError):
        ivf.build(none, 3)


def test_blocks_of_a_bank_come_round(spark, monkeypatch):
    """Blocks in one round or several, chunks of few queries, ties, and fewer rows than neighbours: all as one broadcast bank gives them."""
    random = np.random.default_rng(6)
    bank = vectors(spark, random.integers(0, 3, (90, 3)))
    queries = vectors(spark, random.integers(0, 3, (50, 3)), "image_id").repartition(3)
    monkeypatch.setattr(knn, "CHUNK_ROWS", 7)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    size = knn.bank_bytes(bank)
    for k in (4, 200):
        want = rows(knn.nearest(queries, ["image_id"], bank, k))
        for round_bytes in (size * 2, size // 2):
            assert rows(knn.nearest(queries, ["image_id"], bank, k, limit=size // 5, round_bytes=round_bytes)) == want
    plan = knn.nearest(queries, ["image_id"], bank, 4, limit=size // 5)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan
    near = knn.nearest(queries, ["image_id"], bank, 5)
    for metric in ("euclidean", "squared_euclidean"):
        for rest in ({}, {"limit": size // 5}, {"limit": size // 5, "round_bytes": size // 2}):
            assert rows(knn.mean_distances(queries, ["image_id"], bank, metric, [5], **rest)) == rows(knn.averaged(near, ["image_id"], metric))
            assert rows(knn.mean_distances(queries, ["image_id"], bank, metric, [1, 5], "k", **rest)) == rows(knn.averaged_each(near, ["image_id"], metric, [1, 5], "k"))


def test_index_with_all_probes_is_exact(spark):
    random = np.random.default_rng(2)
    bank, queries = vectors(spark, random.normal(size=(300, 6))), vectors(spark, random.normal(size=(40, 6)), "image_id")
    rows, centroids = ivf.build(bank, 7)
    rows = rows.cache()
    want = sorted(tuple(r) for r in knn.nearest(queries, ["image_id"], bank, 5).collect())
    for limit in (knn.BROADCAST_BYTES, 0):
        assert sorted(tuple(r) for r in ivf.nearest_probed(queries, ["image_id"], rows, centroids, 5, 7, limit=limit).collect()) == want
    few = [sorted(tuple(r) for r in ivf.nearest_probed(queries, ["image_id"], rows, centroids, 60, 1, limit=limit).collect()) for limit in (knn.BROADCAST_BYTES, 0)]
    assert few[0] == few[1]
    counts = ivf.probes(queries, ["image_id"], centroids, 3).groupBy("image_id").count().collect()
    assert {r["count"] for r in counts} == {3}
    assert ivf.effective_clusters(32, 10) == 10 and ivf.effective_clusters(1, 10) == 2
    assert ivf.uses_index(True, 32, 32) and not ivf.uses_index(True, 31, 32)


def test_probed_clusters_bound_each_other(spark):
    """Clusters with and without boxes, ties and queries of one partition: the rows of brute force, from several tasks."""
    random = np.random.default_rng(11)
    points = np.concatenate([random.normal(size=(9000, 3)), np.round(random.normal(size=(900, 3)) + 5), random.normal(size=(40, 3)) - 9])
    centroids = np.array([[-1.0, 0, 0], [1, 0, 0], [5, 5, 5], [-9, -9, -9]])
    owner = squared_matrix(points, centroids).argmin(axis=1)
    queries = np.concatenate([random.normal(size=(300, 3)), points[9000:9050], random.normal(size=(20, 3)) - 9])
    cells = ivf.Cells(np.arange(len(points)), points, owner, centroids)
    assert [c.tree is not None for c in cells.cells] == [True, True, False, False]
    for k, n in ((1, 1), (7, 2), (7, 3), (7, 4), (60, 2), (60, 1)):
        probed = np.argsort(squared_matrix(queries, centroids), axis=1, kind="stable")[:, :n]
        got = {}
        for own, near, ids in cells.nearest(queries, k, n):
            got |= {int(q): (d.tolist(), i.tolist()) for q, d, i in zip(own, near, ids, strict=True)}
        for q, own in enumerate(probed):
            inside = np.flatnonzero(np.isin(owner, own))
            inside = inside if len(inside) >= k else np.arange(len(points))
            d2 = squared_matrix(queries[q : q + 1], points[inside])[0]
            best = np.lexsort((inside, d2))[:k]
            assert got[q][1] == inside[best].tolist() and np.allclose(got[q][0], d2[best], rtol=1e-12, atol=0)
    bank = spark.createDataFrame([(k, v.tolist(), int(c)) for k, (v, c) in enumerate(zip(points, owner, strict=True))], "bank_id long, emb array<double>, cluster_id int")
    asked = vectors(spark, queries, "image_id").coalesce(1)
    found = ivf.nearest_probed(asked, ["image_id"], bank, centroids, 7, 2)
    assert found.rdd.getNumPartitions() > 1 and found.count() == 7 * len(queries)


def test_coreset(spark):
    random = np.random.default_rng(3)
    points = random.normal(size=(200, 3))
    bank = vectors(spark, points)
    one_task = coreset.sample(bank, 0.1).orderBy("pick").collect()
    loop = coreset.sample(bank, 0.1, limit=0).orderBy("pick").collect()
    ids = [r["bank_id"] for r in one_task]
    assert ids == [r["bank_id"] for r in loop] and len(set(ids)) == 20
    radius = [squared_matrix(points, points[ids[:m]]).min(axis=1).max() for m in range(1, 21)]
    assert all(a >= b for a, b in zip(radius, radius[1:], strict=False))
    assert [r["bank_id"] for r in coreset.sample(vectors(spark, points[:4]), 1.0).orderBy("pick").collect()] == [0, 1, 2, 3]
    assert coreset.sample(bank.limit(0), 0.5).count() == 0
    assert coreset.farthest_first(np.zeros((3, 2)), 1, 3) == [1, 0, 0]


def test_coreset_in_passes(spark, monkeypatch):
    """Many ties, so that the order of picks depends on ids, and few candidates in a pass."""
    monkeypatch.setattr(coreset, "CANDIDATES", 8)
    monkeypatch.setattr(coreset, "PART", 7)
    monkeypatch.setattr(coreset, "ROWS_A_PIVOT", 20)
    monkeypatch.setattr(coreset, "PIECE_ROWS", 30)
    random = np.random.default_rng(8)
    for points in (random.integers(0, 4, (45, 2)), np.zeros((20, 2))):
        bank = vectors(spark, points).repartition(3)
        pick = lambda limit, bank=bank: [(r["pick"], r["bank_id"], list(r["emb"])) for r in coreset.sample(bank, 0.2, limit=limit).orderBy("pick").collect()]
        assert pick(0) == pick(coreset.ONE_TASK_BYTES)


def test_coreset_reads_only_what_a_member_can_reach(spark, monkeypatch):
    """Far groups of rows: a pass leaves out the pieces whose rows are near a member already, and members that reach no row of a piece."""
    monkeypatch.setattr(coreset, "ROWS_A_PIVOT", 40)
    monkeypatch.setattr(coreset, "CANDIDATES", 60)
    random = np.random.default_rng(4)
    spread = np.repeat([30.0, 3.0, 0.3, 0.03], 200)[:, None]
    points = np.repeat(np.arange(4) * 1000.0, 200)[:, None] + spread * random.normal(size=(800, 3))
    bank, work = vectors(spark, points), coreset.Work()
    got = [r["bank_id"] for r in coreset.sample(bank, 0.15, limit=0, work=work).orderBy("pick").collect()]
    assert got == [r["bank_id"] for r in coreset.sample(bank, 0.15).orderBy("pick").collect()]
    assert work.members == 120 and work.rows < 0.7 * work.passes * 800 and work.pairs < 0.2 * 120 * 800


def test_all_rows_as_a_coreset(spark):
    bank = vectors(spark, [[k, 1] for k in range(50)]).repartition(3)
    for limit in (0, coreset.ONE_TASK_BYTES):
        assert [(r["pick"], r["bank_id"]) for r in coreset.sample(bank, 1.0, limit=limit).orderBy("pick").collect()] == [(k, k) for k in range(50)]


def test_split_keeps_columns(spark):
    df = spark.createDataFrame([(i, "OK" if i % 3 else "NG", i, i, i) for i in range(30)], "image_id long, class string, digest int, prefix int, place int")
    rows = split.split(df.select("image_id", "class", "digest", "prefix")).collect()
    assert all(r["digest"] == r["prefix"] == r["image_id"] for r in rows) and len(rows) == 30


def test_split_sizes():
    assert split.ok_sizes(10, (0.6, 0.2, 0.2)) == (6, 2, 2)
    assert split.ok_sizes(1, (0.6, 0.2, 0.2)) == (1, 0, 0)
    assert split.ok_sizes(5, (-1, 0, 0)) == split.ok_sizes(5, (0.6, 0.2, 0.2))
    assert split.ng_sizes(6, 0.5) == (0, 3, 3) and split.ng_sizes(1, 0.5) == (0, 0, 1) and split.ng_sizes(100, 0) == (0, 5, 95)
    assert split.ok_count_sizes(5, 3, 9) == (3, 2, 0) and split.ng_count_sizes(2, 5) == (0, 2, 0)
    with pytest.raises(ValueError):
        split.ok_count_sizes(5, 0, 1)


def test_split_covers(spark):
    df = spark.range(137).select(F.col("id").alias("image_id"), F.when(F.col("id") % 5 == 0, "NG").otherwise("OK").alias("class"))
    rows = split.split(df).collect()
    assert sorted(r["image_id"] for r in rows) == list(range(137))
    ok = [r["subset"] for r in rows if r["class"] == "OK"]
    assert [ok.count(s) for s in ("train", "tune", "test")] == list(split.ok_sizes(len(ok), (0.6, 0.2, 0.2)))
    assert {(r["image_id"], r["subset"]) for r in split.split(df).collect()} == {(r["image_id"], r["subset"]) for r in rows}
    with pytest.raises(ValueError):
        split.split(df.where("class = 'NG'"))
    parts = split.split(df)
    assert split.can_tune(parts) and not split.can_tune(parts.where("class = 'OK'"))


def labelled(spark, ok, ng):
    return spark.createDataFrame([(float(s), "OK") for s in ok] + [(float(s), "NG") for s in ng], "score double, class string")


def brute_best(ok, ng):
    s = sorted({*ok, *ng})
    s = [*s, s[0] + 1e-4] if len(s) == 1 else s
    every = [*((a + b) / 2 for a, b in zip(s, s[1:], strict=False)), min([*ok, *ng]) - 1e-4, max([*ok, *ng]) + 1e-4]
    best = None
    for t in every:
        tp, fp, fn = sum(x > t for x in ng), sum(x > t for x in ok), sum(x <= t for x in ng)
        f1 = 2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0.0
        if best is None or f1 > best[1]:
            best = (t, f1)
    return best


def test_thresholds(spark):
    random = np.random.default_rng(5)
    cases = [([1, 2], [3, 4]), ([5], [5]), ([3, 4], [1, 2]), (random.integers(0, 20, 40).tolist(), random.integers(5, 25, 30).tolist())]
    for ok, ng in cases:
        r = tuning.best_threshold(labelled(spark, ok, ng)).first()
        t, f1 = brute_best(ok, ng)
        assert (r["threshold"], r["f1"]) == (pytest.approx(t), pytest.approx(f1))
        assert r["tp"] == sum(x > t for x in ng) and r["tn"] == sum(x <= t for x in ok)
    assert tuning.best_threshold(labelled(spark, [1, 2], [])).count() == 0
    # all groups at once; one without NG rows has no threshold
    every = labelled(spark, [1, 2], []).withColumn("k", F.lit(99))
    for k, (ok, ng) in enumerate(cases):
        every = every.unionByName(labelled(spark, ok, ng).withColumn("k", F.lit(k)))
    got = {r["k"]: (r["threshold"], r["f1"]) for r in tuning.best_threshold(every, ["k"]).collect()}
    assert got == {k: pytest.approx(brute_best(*case)) for k, case in enumerate(cases)}
    assert tuning.best_threshold(every.limit(0), ["k"]).count() == 0
    r = tuning.confusion(labelled(spark, [1.0], []), 1.0).first()
    assert (r["tn"], r["fp"], r["f1"], r["precision"]) == (1, 0, 0.0, 0.0)  # equal to the threshold is OK


def test_averages_for_several_k(spark):
    near = knn.nearest(vectors(spark, [[0, 0], [9, 1]], "image_id"), ["image_id"], vectors(spark, [[1, 0], [0, 2], [3, 0]]), 3)
    each = knn.averaged_each(near, ["image_id"], "squared_euclidean", [1, 2, 5], "k")
    got = {(r["image_id"], r["k"]): r["dist"] for r in each.collect()}
    for k in (1, 2, 5):
        for r in knn.averaged(near.where(F.col("rank") <= k), ["image_id"], "squared_euclidean").collect():
            assert got.pop((r["image_id"], k)) == r["dist"]
    assert not got
    with pytest.raises(ValueError):
        tuning.candidates_of("k", [])


@pytest.mark.parametrize("module, call", [
    (knn, lambda b, q: knn.nearest(q, ["image_id"], b, 1)), (knn, lambda b, q: knn.nearest(q, ["image_id"], b, 1, limit=0)),
    (ivf, lambda b, q: ivf.build(b, 2)), (ivf, lambda b, q: ivf.probes(q, ["image_id"], np.zeros((2, 2)), 1)),
    (coreset, lambda b, q: coreset.sample(b, 0.5)), (coreset, lambda b, q: coreset.sample(b, 0.5, limit=0)),
    (features, lambda b, q: features.patches(q, "image_id", "emb", (1, 1, 2))),
])
def test_code_is_shipped(spark, monkeypatch, module, call):
    """Workers of a cluster have this package only if the operator hands it over."""
    sent = []
    monkeypatch.setattr(module, "ship", lambda session: sent.append(session))
    call(vectors(spark, [[0, 1], [2, 3], [4, 5]]), vectors(spark, [[0, 0]], "image_id"))
    assert sent


def test_passes_of_a_coreset_leave_nothing(spark):
    import os
    import urllib.parse

    from lodestone.shared import shared_folder

    folder = urllib.parse.urlparse(shared_folder(spark)).path
    picks = coreset.sample(vectors(spark, [[k * k, k] for k in range(40)]), 0.25, limit=0).orderBy("pick")
    assert [r["bank_id"] for r in picks.collect()] == [r["bank_id"] for r in coreset.sample(vectors(spark, [[k * k, k] for k in range(40)]), 0.25).orderBy("pick").collect()]
    assert not [f for f in os.listdir(folder) if f.startswith("coreset-")]
    told = []
    coreset.sample(vectors(spark, [[k * k, k] for k in range(40)]), 0.25, limit=0, report=lambda done, every: told.append((done, every)))
    assert told[-1] == (10, 10) and told == sorted(told)


def test_searches():
    rows = [{"num_neighbors": k, "f1": f, "threshold": 0.0} for k, f in ((1, 0.5), (3, 0.7), (5, 0.7), (9, 0.6))]
    assert tuning.best_neighbors(rows)["num_neighbors"] == 3
    probes = [{"ann_probes": p, "f1": f} for p, f in ((1, 0.5), (2, 0.5 + 5e-7), (4, 0.6))]
    assert tuning.best_probes(probes)["ann_probes"] == 4 and tuning.best_probes(probes[:2])["ann_probes"] == 1
    assert tuning.probe_candidates(10) == [1, 2, 4, 6, 8, 10] and tuning.probe_candidates(8, [3, 99, 3]) == [3, 8]


def test_order_statistics(spark, monkeypatch):
    monkeypatch.setattr(ordered, "FEW", 10)
    random = np.random.default_rng(6)
    for values in (random.normal(size=500).tolist(), [1.0] * 300 + [2.0] * 300 + [0.5], random.integers(0, 9, 400).astype(float).tolist()):
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
        for rank in (0, 1, 250, len(values) - 1):
            assert ordered.at_rank(df, "v", rank) == sorted(values)[rank]
        assert ordered.p95(df, "v") == sorted(values)[ordered.p95_rank(len(values))]
    assert ordered.p95(df.limit(0), "v") is None


def test_running(spark):
    df = spark.createDataFrame([(float(k * 37 % 101), k) for k in range(101)], "s double, n long")
    got = ordered.running(df, "s", ["n"]).orderBy("s").collect()
    total = 0
    for k, r in enumerate(got):
        total += r["n"]
        assert r["cum_n"] == total and r["next_key"] == (got[k + 1]["s"] if k + 1 < len(got) else None)
    parted = ordered.running(df.withColumn("g", F.expr("int(sqrt(s))")), "s", ["n"], ["g"]).orderBy("g", "s").collect()
    assert len(parted) == 101
    for k, r in enumerate(parted):
        same = [x for x in parted if x["g"] == r["g"]]
        assert r["cum_n"] == sum(x["n"] for x in same if x["s"] <= r["s"])
        assert r["next_key"] == min((x["s"] for x in same if x["s"] > r["s"]), default=None)


def test_scalars(spark):
    text = lambda c: one(spark, c)
    assert [text(scalars.elapsed(F.lit(float(ms)))) for ms in (5, 999.6, 1500, 90_000, 5_400_000)] == ["5ms", "1000ms", "1.5s", "1.5m", "1.5h"]
    assert text(scalars.percentage(F.lit(1.0), F.lit(8.0))) == "12.5%" and text(scalars.percentage(F.lit(1.0), F.lit(0.0))) == ""
    assert text(scalars.sanitised(F.lit(' a/b:c* '))) == "abc" and text(scalars.sanitised(F.lit("?"))) == "default"
    assert text(scalars.without_variant(F.lit("net_FUSED_fp16_int8"))) == "net"
    assert text(scalars.stem(F.lit("a/b.c/d.e.png"))) == "d.e" and text(scalars.extension(F.lit("a.b/c"))) == ""
    assert [one(spark, scalars.kernel_size(F.lit(n), F.lit(n))) for n in (28, 4)] == [25, 5]


def test_config():
    c = EngineConfig()
    assert EngineConfig.from_stored(c.stored()) == c and c.stored()["DistanceMetric"] == 1
    for bad in ({"image_size": 32}, {"patch_size": 2}, {"coreset_ratio": 0}, {"metric": "x"}, {"ann_clusters": 1}, {"downscale": 9}):
        with pytest.raises(ValueError):
            EngineConfig(**bad)
    assert normalised_ratios([0, 0, 0]) == [0.6, 0.2, 0.2] and normalised_ratios([1, 1, 2]) == [0.25, 0.25, 0.5]
    assert EngineConfig.from_stored({"OkTunePath": "x", "NgTuneRatio": 3}).ok_path == "x"
    merged = EngineConfig(patch_size=5, batch_size=4).for_inference({"patch_size": 3, "metric": None})
    assert (merged.patch_size, merged.batch_size, merged.metric) == (3, 4, "euclidean")
    assert EngineConfig(batch_size=0).effective_batch == 8
    model = {"image_size": 128, "num_neighbors": 5, "threshold": 0.7, "use_ann": True, "ann_probes": 2, "embed_dim": 6, "metric": "euclidean", "backbone_id": " "}
    user = EngineConfig(use_gpu=False, embed_dim=64)
    merged = user.for_inference(model, EngineConfig(backbone_id="resnet18", custom_backbone_path="c.onnx"))
    assert (merged.image_size, merged.num_neighbors, merged.threshold, merged.use_ann, merged.ann_probes, merged.use_gpu) == (128, 5, 0.7, True, 2, False)
    assert (merged.backbone_id, merged.custom_backbone_path, merged.embed_dim) == ("resnet18", "c.onnx", 64)
    assert EngineConfig(use_manual_threshold=True, threshold=0.2).for_inference(model).threshold == 0.2


def test_progress():
    from lodestone.plans.progress import Progress, elapsed

    assert [elapsed(ms) for ms in (5, 999.6, 1500, 90_000, 5_400_000)] == ["5ms", "1000ms", "1.5s", "1.5m", "1.5h"]
    lines = []
    steps = Progress(lines.append)
    for name in ("a", "b", "a"):
        with steps.step(name):
            pass
    assert list(steps.stages) == ["a", "b"] and lines[0] == "a ..." and len(lines) == 6
    steps.stages = {"a": 750.0, "b": 250.0}
    assert steps.summary() == ["a 750ms | b 250ms | total 1.0s", "a 75.0% | b 25.0%"]
    assert Progress().summary() == ["total 0ms", ""]
    tell = Progress(lines.append).counter("coreset")
    tell(0, 8)
    tell(2, 8)
    tell(8, 8)
    assert lines[-3].startswith("coreset 0/8 (0%) | ") and lines[-3].endswith("| ? left")
    assert lines[-2].startswith("coreset 2/8 (25%) | ") and lines[-1].endswith("| 0ms left")


def test_paths(tmp_path):
    from lodestone.sources import catalog, paths

    (tmp_path / "models").mkdir()
    (tmp_path / "a" / "b").mkdir(parents=True)
    assert paths.root(tmp_path / "a" / "b") == tmp_path and paths.resolved("x/y", tmp_path / "a") == tmp_path / "x" / "y"
    assert paths.resolved(tmp_path / "z") == tmp_path / "z"
    start = tmp_path / "a"
    assert catalog.status("resnet18", start=start) == "missing: resnet18_features.onnx"
    (tmp_path / "models" / "resnet18_features_fused_int8.onnx").write_bytes(b"")
    assert catalog.status("resnet18", start=start) == "ready: resnet18_features_fused_int8.onnx"
    assert "slower" in catalog.status("resnet18", prefer_gpu=True, start=start) and "needs a file" in catalog.status("custom", start=start) and "no backbone" in catalog.status("x")
    assert catalog.by_file("models/resnet18_features_fused_int8.onnx", start=start) == "resnet18" and catalog.by_file("models/other.onnx", start=start) == "custom"


def test_a_query_meets_only_the_boxes_near_it():
    rng = np.random.default_rng(3)
    for width in (2, 4, 8):
        rows = np.concatenate([rng.normal(size=(4000, width)), rng.integers(0, 3, size=(2000, width)), np.zeros((300, width)), 1e6 + rng.normal(size=(200, width))])
        bank, queries = Bank(rows, np.sort(rng.choice(10**6, len(rows), replace=False))), np.concatenate([rows[::7], 9 * rng.normal(size=(50, width))])
        near, found = bank.nearest(queries, 9)
        tree, bank.tree = bank.tree, None
        plain, plain_ids = bank.nearest(queries, 9)
        assert (near == plain).all() and (found == plain_ids).all()
        lowered = np.where(np.arange(len(queries)) % 2, 0.05, np.inf)
        wanted = np.minimum(lowered, plain[:, 0])
        tree.lower(lowered, queries)
        assert (lowered == wanted).all()
    rows, met = rng.normal(size=(40_000, 4)), 0
    tree, reached = Bank(rows, np.arange(40_000)).tree, []
    tree._reached = lambda *a, own=tree._reached: reached.append(len(own(*a))) or own(*a)
    for at, *_ in tree.pairs(rows[:20_000], 9):
        met += len(at) * reached[-1]
    assert met < 20_000 * 40_000 / 8


def test_near_queries_are_dealt_together(spark):
    rng = np.random.default_rng(4)
    rows = rng.normal(size=(3000, 3)).tolist()
    bank, queries = vectors(spark, rows), spark.createDataFrame([(k, r) for k, r in enumerate(rows[::3])], "image_id long, emb array<double>")
    by_boxes, by_blocks = (sorted(map(tuple, knn.nearest(queries, ["image_id"], bank, 4, limit=limit).collect())) for limit in (knn.BROADCAST_BYTES, 30_000))
    assert by_boxes == by_blocks and len(by_boxes) == 4000


def test_members_by_boxes(spark):
    """The members and their order are those of the plain method, with ties and copies; a narrow bank takes few passes, as all candidates meet in a task."""
    rng = np.random.default_rng(5)
    rows = np.concatenate([rng.normal(size=(2500, 3)), rng.integers(0, 4, size=(1500, 3)), np.zeros((100, 3))])
    near = coreset.squared_from(rows, rows[7])
    by_boxes, pairs = coreset.picked(np.arange(len(rows)), rows, near.copy(), 0.0, False, 600)
    by_heap, _ = coreset._picked_by_heap(rows, near.copy(), 0.0, False, 600)
    assert by_boxes == by_heap and len(by_boxes) == 600 and pairs < 600 * len(rows) / 4
    short = coreset.picked(np.arange(2200), np.repeat(rows[:2], 1100, axis=0), coreset.squared_from(np.repeat(rows[:2], 1100, axis=0), rows[0]), 0.0, False, 9)[0]
    assert short == [1100]
    work = coreset.Work()
    bank = vectors(spark, rows)
    got = [r["bank_id"] for r in coreset.sample(bank, 0.1, limit=0, work=work).orderBy("pick").collect()]
    first = got[0]
    plain = [first, *coreset._picked_by_heap(rows.astype(np.float32).astype(float), coreset.squared_from(rows.astype(np.float32).astype(float), rows[first].astype(np.float32).astype(float)), 0.0, False, len(got) - 1)[0]]
    assert got == plain and work.passes <= 3


def test_members_by_blocks(spark, monkeypatch):
    """Wide vectors: the members of the plain method in its order, with ties, copies and any scale, and few distances taken for them; passes of few candidates give the same."""
    rng = np.random.default_rng(6)
    spread = rng.normal(size=(4000, 32))
    plain = lambda rows, near, most: coreset._picked_by_heap(rows, near.copy(), 0.0, False, most)[0]
    tight = np.concatenate([spread[:1500], spread[0] + 1e-5 * rng.normal(size=(1500, 32))])
    for rows in (spread, spread + 1e6, spread * 1e20, spread * 1e-25, tight, rng.integers(0, 2, size=(3000, 9)).astype(float), np.repeat(spread[:30], 100, axis=0)):
        near = coreset.squared_from(rows, rows[7])
        found, pairs = coreset.picked(np.arange(len(rows)), rows, near.copy(), 0.0, False, 400)
        assert found == plain(rows, near, 400)
        assert rows is not spread or pairs < 400 * len(rows) / 10
    monkeypatch.setattr(coreset, "CANDIDATES", 1500)
    monkeypatch.setattr(coreset, "BLOCK", 64)
    monkeypatch.setattr(coreset, "ROWS_A_PIVOT", 500)
    rows, work = spread.astype(np.float32).astype(float), coreset.Work()
    got = [r["bank_id"] for r in coreset.sample(vectors(spark, rows), 0.2, limit=0, work=work).orderBy("pick").collect()]
    assert got == [got[0], *plain(rows, coreset.squared_from(rows, rows[got[0]]), 799)] and work.passes > 1


def test_rows_lowered_by_members():
    """Estimates in float32 leave out no nearest member, wherever the rows lie."""
    rng = np.random.default_rng(7)
    rows = rng.normal(size=(500, 20))
    for own in (rows, rows + 1e5, rows * 1e-20, rows * 1e18, np.concatenate([rows, rows[:1] + 1e-7 * rng.normal(size=(100, 20))])):
        members = own[rng.permutation(len(own))[:90]]
        near, want = np.full(len(own), np.inf), squared_matrix(own, members).min(axis=1)
        coreset.relaxed(near, own, members)
        assert np.allclose(near, want, rtol=1e-12, atol=0)


def test_probes_in_one_pass(spark, monkeypatch):
    """All numbers of probes from one pass, by one broadcast and by blocks: what searches one by one give, with ties, copies, small clusters and rows without a vector."""
    rng = np.random.default_rng(11)
    monkeypatch.setattr(Bank, "PART", 50)
    spread = np.concatenate([rng.normal(size=(300, 12)), rng.integers(0, 2, size=(200, 12)), np.repeat(rng.normal(size=(3, 12)), 20, axis=0)])
    for points, k in ((spread, 6), (spread + 1e5, 6), (spread * 1e20, 6), (rng.normal(size=(2500, 3)), 4), (rng.normal(size=(12, 12)), 20), (spread, 70)):
        bank = vectors(spark, points)
        indexed, centroids = ivf.build(bank, 7)
        queries = vectors(spark, points[::5], "image_id").unionByName(spark.createDataFrame([(10**6, None)], "image_id long, emb array<float>"))
        ps, rows = [1, 2, 5, 7], lambda df: sorted((r["image_id"], r["p"], r["dist"]) for r in df.collect())
        one_by_one = tuning.each("p", ps, lambda p: ivf.nearest_probed(queries, ["image_id"], indexed, centroids, k, p, means=knn.Means("squared_euclidean", (k,))))  # noqa: B023
        want = rows(one_by_one)
        for limit in (knn.BROADCAST_BYTES, 12_000):
            assert rows(ivf.swept(queries, ["image_id"], indexed, centroids, k, ps, "squared_euclidean", "p", limit=limit)) == want
        assert len(want) == len(ps) * len(points[::5])
    assert rows(ivf.swept(queries, ["image_id"], indexed, centroids, k, ps, "squared_euclidean", "p", limit=0, round_bytes=1)) == want


def test_probe_sweep_copies_no_query(spark, sf_dir, monkeypatch):
    """Beyond one broadcast the sweep takes the bank's blocks in turn, once for all numbers of probes."""
    from lodestone.plans import catalogue

    want = sorted(catalogue.QUERIES["probe_sweep"](spark, sf_dir).collect())
    passes = []
    monkeypatch.setattr(ivf, "shared_cells", lambda *a, **b: None)
    monkeypatch.setattr(ivf, "blocked", lambda *a, **b: pytest.fail("queries are dealt out to the bank's blocks"))
    monkeypatch.setattr(ivf, "passed", lambda *a, f=knn.passed: passes.append(1) or f(*a))
    assert sorted(catalogue.QUERIES["probe_sweep"](spark, sf_dir).collect()) == want and passes == [1]
