"""Map and image expressions against the numpy kernels, and the sinks that are built on them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import images, maps
from lodestone.operators import features
from lodestone.plans import render


@pytest.mark.parametrize("shape, to", [((4, 4), (7, 3)), ((1, 5), (3, 2)), ((3, 2), (3, 2)), ((5, 3), (2, 1))])
def test_resized(spark, shape, to):
    random = np.random.default_rng(1)
    points = random.normal(size=(3, *shape))
    colour = random.normal(size=(3, *shape, 3))
    rows = [(i, p.reshape(-1).tolist(), c.reshape(-1).tolist()) for i, (p, c) in enumerate(zip(points, colour, strict=True))] + [(9, None, None)]
    df = spark.createDataFrame(rows, "id int, a array<double>, b array<double>")
    got = {r["id"]: r for r in df.select("id", maps.resized(F.col("a"), shape, to).alias("a"), maps.resized(F.col("b"), shape, to, 3).alias("b")).collect()}
    assert got[9]["a"] is None and got[9]["b"] is None
    for i in range(3):
        assert np.allclose(got[i]["a"], images.resized(points[i], *to).reshape(-1)) and np.allclose(got[i]["b"], images.resized(colour[i], *to).reshape(-1))


@pytest.mark.parametrize("shape", [(4, 4), (2, 7), (30, 26)])
def test_smoothed(spark, shape):
    points = np.random.default_rng(2).normal(size=shape)
    df = spark.createDataFrame([(points.reshape(-1).tolist(),)], "a array<double>")
    assert np.allclose(df.select(maps.smoothed(F.col("a"), shape)).first()[0], images.smoothed(points).reshape(-1))


def test_overlay_is_the_heatmap(spark):
    random = np.random.default_rng(3)
    scores, image = random.normal(size=(4, 5)), random.integers(0, 256, (12, 9, 3))
    flat = np.ones((4, 5))
    df = spark.createDataFrame([(s.reshape(-1).tolist(), image.reshape(-1).astype(float).tolist()) for s in (scores, flat)], "s array<double>, i array<double>")
    got = [r[0] for r in df.select(maps.overlay(F.col("i"), F.col("s"), (4, 5), (12, 9))).collect()]
    want = [images.heatmap(image.astype(np.uint8), s).astype(int).reshape(-1).tolist() for s in (scores, flat)]
    assert got == want


@pytest.mark.parametrize("mode", ["fused", "standard", "normalised"])
def test_preprocessed(spark, mode):
    image = np.random.default_rng(4).integers(0, 256, (6, 4, 3)).astype(np.uint8)
    df = spark.createDataFrame([(image.reshape(-1).astype(float).tolist(),), (None,)], "i array<double>")
    got, none = (r[0] for r in df.select(maps.preprocessed(F.col("i"), (6, 4), 8, mode)).collect())
    assert none is None and np.allclose(got, images.preprocessed(image, 8, mode).reshape(-1), atol=1e-6)
    with pytest.raises(ValueError):
        maps.preprocessed(F.col("i"), (6, 4), 8, "x")


def test_fused(spark):
    random = np.random.default_rng(5)
    near, far, projection, bias = random.normal(size=(4, 2, 6, 5)), random.normal(size=(4, 3, 2, 3)), random.normal(size=(4, 5)), random.normal(size=4)
    rows = [(i, a.reshape(-1).tolist(), b.reshape(-1).tolist(), "kept") for i, (a, b) in enumerate(zip(near, far, strict=True))] + [(7, None, [0.0] * 18, "kept"), (8, [0.0] * 60, None, "kept")]
    df = spark.createDataFrame(rows, "id int, near array<float>, far array<double>, data string")
    got = {r["id"]: r["data"] for r in features.fused(df, "near", (2, 6, 5), "far", (3, 2, 3), projection, bias).collect()}
    assert got[7] is None and got[8] is None
    for i in range(4):
        up = np.stack([images.resized(c, 6, 5) for c in far[i]])
        want = np.einsum("tc,cyx->tyx", projection, np.concatenate([near[i], up])) + bias[:, None, None]
        assert np.allclose(got[i], want.reshape(-1), atol=1e-5)
    with pytest.raises(ValueError):
        features.fused(df, "near", (2, 6, 5), "far", (4, 2, 3), projection)


def test_files_are_written_where_they_are_made(spark, tmp_path):
    from lodestone.sources import files

    rows = spark.createDataFrame([(f"a{k}.png", bytes([k]) * k, k) for k in range(20)], "name string, content binary, more int").repartition(4)
    files.write(rows, str(tmp_path / "out"))
    found = {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir() if p.name != "_SUCCESS"}
    assert found == {f"a{k}.png": bytes([k]) * k for k in range(20)} and (tmp_path / "out" / "_SUCCESS").read_text() == "20"
    files.write(rows, str(tmp_path / "out"))
    assert len(list((tmp_path / "out").iterdir())) == 21
    with pytest.raises(ValueError):
        files.write(rows.select("name"), str(tmp_path)) if "content" in rows.select("name").columns else files.Files({"path": "x"}).writer(rows.select("name").schema, False)


def test_a_task_that_fails_leaves_no_double_and_no_rest(spark, tmp_path):
    from pyspark.sql import Row

    from lodestone.sources import files

    writer = files.FilesWriter(str(tmp_path))

    def breaking():
        yield Row(name="x", content=b"1")
        raise OSError("lost")

    with pytest.raises(OSError):
        writer.write(breaking())
    again = writer.write(iter([Row(name="x", content=b"1"), Row(name="y", content=None)]))  # the task is tried again
    assert sorted(p.name for p in tmp_path.iterdir()) == ["x", "y"] and (tmp_path / "x").read_bytes() == b"1" and again.count == 2
    writer.abort([again, None])
    assert [p.name for p in tmp_path.iterdir()] == ["x"]  # it was there before
    rows = spark.createDataFrame([("ok", b"1"), ("bad/name", b"2")], "name string, content binary").repartitionByRange(2, "name")
    with pytest.raises(Exception, match="no file name"):
        files.write(rows, str(tmp_path / "new"))
    assert not (tmp_path / "new" / "_SUCCESS").exists()


def test_a_batch_is_cancelled_and_taken_up_again(spark, tmp_path):
    from lodestone.plans.batch import Batch, Cancelled

    rows = spark.range(200).withColumnRenamed("id", "image_id")
    scored = []

    def score(part):
        scored.append(sorted(r[0] for r in part.collect()))
        return part.withColumn("score", F.col("image_id") * 0.5)

    batch = Batch(rows, score, str(tmp_path / "b"), parts=5)
    told = []

    def report(done, parts):
        told.append((done, parts))
        if done == 2:
            batch.cancel()

    with pytest.raises(Cancelled):
        batch.run(report)
    assert told == [(1, 5), (2, 5)] and len(batch.done()) == 2
    got = Batch(rows, score, str(tmp_path / "b"), parts=5).run()
    assert sorted(tuple(r) for r in got.collect()) == [(k, k * 0.5) for k in range(200)]
    assert sorted(x for part in scored for x in part) == list(range(200))  # no image twice


def test_a_running_part_is_interrupted(spark, tmp_path):
    import threading
    import time

    from lodestone.plans.batch import Batch, Cancelled

    def slow(batches):
        for b in batches:
            time.sleep(20)
            yield b

    batch = Batch(spark.range(8).withColumnRenamed("id", "image_id"), lambda part: part.mapInArrow(slow, "image_id long"), str(tmp_path / "b"), parts=2)
    threading.Timer(3, batch.cancel).start()
    began = time.monotonic()
    with pytest.raises(Cancelled):
        batch.run()
    assert time.monotonic() - began < 15 and batch.done() == []


def test_seven_stage_times_of_one_job(spark):
    import time

    from lodestone.config import EngineConfig
    from lodestone.plans import pipeline, render
    from lodestone.plans.progress import StageTimes
    from lodestone.sources import images as source

    random = np.random.default_rng(8)
    pictures = spark.createDataFrame([(f"/p/{k}.png", 32, 32, 3, random.integers(0, 256, (32, 32, 3)).astype(np.uint8).tobytes()) for k in range(12)], "path string, height int, width int, channels int, data binary").repartition(3)
    shape = source.shape_of(source.block_statistics, 32)
    model = pipeline.train(source.features(pictures, size=32), EngineConfig(coreset_ratio=0.2, patch_size=3, num_neighbors=3), shape)
    times = StageTimes(spark)
    scorer = pipeline.Scorer(model, shape, times=times)
    began = time.monotonic()
    scored = scorer.score_maps(source.features(pictures, size=32, times=times))
    rows = pipeline.judged_timed(scored, model.threshold, times, "scores")
    drawn = render.heatmaps(pictures, rows.withColumnRenamed("image_id", "path"), *shape[1:], times=times)
    assert drawn.count() >= 0 and len(drawn.collect()) == 12
    wall = time.monotonic() - began
    seconds = times.seconds()
    assert list(seconds) == list(StageTimes.STAGES) and all(s > 0 for s in seconds.values()) and sum(seconds.values()) <= 4 * wall
    plain = {r["image_id"]: (r["score"], r["is_anomaly"], r["label"]) for r in pipeline.predict(source.features(pictures, size=32), model, shape).collect()}
    assert {r["image_id"]: (r["score"], r["is_anomaly"], r["label"]) for r in rows.collect()} == plain


def test_a_custom_network_has_variants(tmp_path):
    from lodestone.sources import catalog

    for name in ("own.onnx", "own_fp16.onnx"):
        (tmp_path / name).write_bytes(b"")
    assert catalog.model_file("custom", str(tmp_path / "own.onnx"), prefer_gpu=True).name in catalog.variant_names("own", True)
    assert catalog.model_file("custom", str(tmp_path / "own.onnx"), prefer_gpu=True).name == catalog.preferred_file(tmp_path / "own.onnx", True).name


@pytest.mark.parametrize("n", [1, 3000])
def test_a_document_is_read_and_written_in_parts(spark, tmp_path, n):
    import json

    from lodestone.sources import models

    random = np.random.default_rng(9)
    emb = random.normal(size=(n, 6)).astype(np.float32)
    emb[0, 0], emb[-1, 1] = 1e-20, -3e15
    bank = spark.createDataFrame([(k, e.tolist()) for k, e in enumerate(emb)], "bank_id long, emb array<float>").repartition(4)
    model = models.Model(bank=bank, embed_dim=6, height=2, width=2, threshold=0.25, metric="squared_euclidean", backbone_id="a]b [1, 2]c")
    path = str(tmp_path / "model.json")
    models.write_document(model, path)
    document = json.loads((tmp_path / "model.json").read_text())
    assert np.array_equal(np.array(document["MemoryBank"], dtype=np.float32), emb) and document["BackboneId"] == "a]b [1, 2]c"
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")  # many splits
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        back = models.read_document(spark, path)
        rows = back.bank.orderBy("bank_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r["bank_id"] for r in rows] == list(range(n)) and np.array_equal(np.array([r["emb"] for r in rows], dtype=np.float32), emb)
    assert back.options() == model.options()
    (tmp_path / "other.json").write_text(json.dumps({"MemoryBank": [[1, 2.5], [3, 4]], "TargetEmbedDimension": 2, "FeatureHeight": 1, "FeatureWidth": 1, "AnomalyThreshold": 0.5}, indent=2))
    other = models.read_document(spark, str(tmp_path / "other.json"))
    assert other.metric == "euclidean" and [list(r["emb"]) for r in other.bank.orderBy("bank_id").collect()] == [[1, 2.5], [3, 4]]
    (tmp_path / "none.json").write_text(json.dumps({"MemoryBank": [], "TargetEmbedDimension": 2, "FeatureHeight": 1, "FeatureWidth": 1, "AnomalyThreshold": 0.5}))
    with pytest.raises(ValueError):
        models.read_document(spark, str(tmp_path / "none.json"))


def test_levels_take_the_scores_once(spark):
    scores = spark.createDataFrame([(1, 0, 2.0), (1, 1, 4.0), (1, 2, 3.0), (2, 0, 5.0), (2, 1, 5.0)], "image_id long, patch_idx int, dist double").mapInArrow(lambda batches: batches, "image_id long, patch_idx int, dist double")
    levels = render.normalised(scores)
    assert sorted((r["image_id"], r["patch_idx"], r["level"]) for r in levels.collect()) == [(1, 0, 0.0), (1, 1, 1.0), (1, 2, 0.5), (2, 0, None), (2, 1, None)]
    assert levels._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
