"""Images, models, profiles, the whole flow, streams, and registered queries."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.config import EngineConfig
from lodestone.functions import images as kernels
from lodestone.operators import ivf, knn
from lodestone.plans import catalogue, pipeline, render
from lodestone.sources import catalog, images, models, profiles, tables
from lodestone.streaming.scoring import score_stream
from tests.conftest import same_rows


def sample(spot: int | None) -> np.ndarray:
    """A grey plate with a square, and for an anomaly a disc."""
    out = np.full((64, 64, 3), 180, dtype=np.uint8)
    out[15:49, 15:49] = (120, 150, 110)
    if spot is not None:
        y, x = np.mgrid[:64, :64]
        out[(y - 20) ** 2 + (x - 30 - 2 * spot) ** 2 <= 25] = (40, 40, 220)
    return out


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("images")
    (top / "ng").mkdir()
    for k in range(10):
        (top / f"ok_{k:02}.PNG").write_bytes(kernels.png(sample(None)))
    for k in range(6):
        (top / "ng" / f"ng_{k:02}.png").write_bytes(kernels.png(sample(k)))
    (top / "notes.txt").write_text("no image")
    return top


def test_images(spark, folder):
    found = [r["path"] for r in images.scan(spark, str(folder)).collect()]
    assert len(found) == 16 and found == sorted(found, key=str.lower)
    assert images.calibration(spark, str(folder), 3).count() == 3
    one = images.decoded(spark, str(folder / "ng" / "ng_03.png")).first()
    assert np.array_equal(np.frombuffer(one["data"], np.uint8).reshape(64, 64, 3), sample(3))
    with pytest.raises(Exception, match="[Pp]ath"):
        images.scan(spark, str(folder / "none")).count()


def test_unreadable_image(spark, tmp_path):
    (tmp_path / "bad.png").write_bytes(b"no image")
    with pytest.raises(Exception, match="can't be read"):
        images.decoded(spark, str(tmp_path)).select("path").collect()


def test_image_kernels():
    flat = np.full((8, 8, 3), 100, dtype=np.uint8)
    assert kernels.preprocessed(flat, 4, "fused").shape == (3, 4, 4) and kernels.preprocessed(flat, 4, "fused").max() == 100
    assert kernels.preprocessed(flat, 4, "standard")[0, 0, 0] == pytest.approx((100 - 0.485) / 255 / 0.229, rel=1e-6)
    assert kernels.preprocessed(flat, 4, "normalised")[0, 0, 0] == pytest.approx((100 / 255 - 0.485) / 0.229, rel=1e-6)
    assert kernels.resized(np.array([[0.0, 4.0]]), 1, 4).tolist() == [[0, 1, 3, 4]]
    assert kernels.kernel_side(28, 28) == 25 and kernels.kernel_side(4, 4) == 5
    with pytest.raises(ValueError):
        kernels.kernel_side(1, 5)
    assert kernels.smoothed(np.full((6, 6), 2.0)) == pytest.approx(np.full((6, 6), 2.0))
    assert np.array_equal(kernels.heatmap(flat, np.ones((4, 4))), flat)
    assert kernels.coloured(np.array([0, 255], dtype=np.uint8)).tolist() == [[128, 0, 0], [0, 0, 128]]


def test_anomalies_are_found_and_drawn(spark, folder, tmp_path):
    pictures = images.decoded(spark, str(folder)).cache()
    maps = images.features(pictures, size=64, batch=4).cache()
    shape = tuple(maps.select("c", "h", "w").first())
    is_ng = F.col("image_id").contains("/ng/")
    config = EngineConfig(coreset_ratio=0.5, num_neighbors=3, patch_size=1)
    model = pipeline.train(maps.where(~is_ng), config, shape)
    rows = {r["image_id"].rpartition("/")[2]: r["label"] for r in pipeline.predict(maps, model, shape).collect()}
    assert all(rows[f"ok_{k:02}.PNG"] == "OK" for k in range(10)) and all(rows[f"ng_{k:02}.png"] == "NG" for k in range(6))
    done = pipeline.train_and_tune(maps.withColumn("class", F.when(is_ng, "NG").otherwise("OK")), config, shape)
    assert done.test["f1"] == 1.0 and len(done.neighbor_sweep) == 5 and not done.probe_sweep
    scorer = pipeline.Scorer(model, shape)
    near = knn.averaged(scorer.neighbours(maps.where(is_ng)), pipeline.KEYS, model.metric)
    drawn = near.groupBy("image_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("patch_idx", "dist"))), lambda p: p["dist"]).alias("scores"), F.max("dist").alias("score"))
    out = render.heatmaps(pictures, drawn.select(F.col("image_id").alias("path"), F.lit("NG").alias("label"), "score", "scores"), *shape[1:]).collect()
    assert len(out) == 6
    assert {r["name"] for r in out} == {f"ng_{k:02}_NG_{s:.4f}.png" for k, s in ((int(r["image_id"][-6:-4]), r["score"]) for r in drawn.collect())}
    (tmp_path / "h.png").write_bytes(bytes(out[0]["content"]))
    assert images.decoded(spark, str(tmp_path / "h.png")).first()["height"] == 64
    with pytest.raises(ValueError):
        pipeline.train(maps.limit(0), config, shape)


def test_an_index_is_made_once(spark, sf_dir, monkeypatch):
    """Training, both searches and the test share an index and its broadcast."""
    made = []
    for name in ("build", "shared_cells"):
        monkeypatch.setattr(ivf, name, lambda *a, f=getattr(ivf, name), name=name, **b: made.append(name) or f(*a, **b))
    done = pipeline.train_and_tune(tables.maps(spark, sf_dir), EngineConfig(coreset_ratio=0.05, use_ann=True, ann_clusters=8), tables.SHAPE)
    assert made == ["build", "shared_cells"] and len(done.probe_sweep) == 5 and done.test


def test_models(spark, tmp_path):
    bank = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.5])], "bank_id long, emb array<float>")
    model = models.Model(bank=bank, embed_dim=2, height=1, width=1, threshold=0.5, metric="squared_euclidean")
    models.save(model, str(tmp_path / "m"))
    back = models.load(spark, str(tmp_path / "m"))
    assert back.options() == model.options() and sorted(map(tuple, back.bank.collect())) == sorted(map(tuple, bank.collect()))
    text = models.to_document(model)
    assert models.from_document(spark, text).options() == model.options()
    without = json.loads(text)
    del without["DistanceMetric"]
    assert models.from_document(spark, json.dumps(without)).metric == "euclidean"
    for broken in ({"MemoryBank": []}, {"MemoryBank": [[1.0]]}, {"MemoryBank": [[1.0, 2.0], [1.0]]}):
        with pytest.raises(ValueError):
            models.from_document(spark, json.dumps(json.loads(text) | broken))
    with pytest.raises(ValueError):
        models.load(spark, str(tmp_path / "config.json"))


def test_profiles(tmp_path):
    config = EngineConfig(num_neighbors=5)
    profiles.save(config, tmp_path / "Beta.json")
    profiles.save(config, tmp_path / "alpha.json")
    assert profiles.listed(tmp_path) == ["alpha", "Beta"] and profiles.load(tmp_path / "Beta.json").profile_name == "Beta"
    assert profiles.last(tmp_path) is None
    profiles.set_last(tmp_path, "Beta")
    assert profiles.last(tmp_path) == "Beta"
    assert profiles.delete(tmp_path, "Beta") and not profiles.delete(tmp_path, "Beta")
    assert profiles.config_path("out/x.json", "a/b").as_posix() == "out/ab/config.json" and profiles.safe_name(" ") == "default"


def test_catalog(tmp_path):
    assert catalog.backbone_id(" WRN50 ") == "wide_resnet50_2"
    with pytest.raises(ValueError):
        catalog.backbone_id("none")
    for n in ("n_fused.onnx", "n_fused_int8.onnx"):
        (tmp_path / n).write_bytes(b"")
    assert catalog.preferred_file(tmp_path / "n_FP16.onnx").name == "n_fused_int8.onnx"
    assert catalog.preferred_file(tmp_path / "n.onnx", prefer_gpu=True).name == "n_fused.onnx"
    assert catalog.preferred_file(tmp_path / "m.onnx").name == "m.onnx"
    assert catalog.export_file("resnet18", "out", fp16=True).as_posix() == "out/resnet18_features_fused_fp16.onnx"


def test_stream(spark, sf_dir, tmp_path):
    maps = tables.maps(spark, sf_dir).select("image_id", "data", "label")
    model = pipeline.train(maps.where("label < 2"), EngineConfig(coreset_ratio=0.02), tables.SHAPE)
    queries = maps.where("label >= 8").select("image_id", "data")
    queries.repartition(3).write.parquet(str(tmp_path / "in"))
    incoming = spark.readStream.schema(queries.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    score_stream(incoming, model, tables.SHAPE, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = {r["image_id"]: r["score"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r["image_id"]: r["score"] for r in pipeline.predict(queries, model, tables.SHAPE).collect()}
    assert got == pytest.approx(want)


def test_predictions_against_numpy(spark, sf_dir):
    """The flow again, in plain numpy."""
    rows = tables.maps(spark, sf_dir).orderBy("image_id").collect()
    data = np.array([r["data"] for r in rows], dtype=np.float64).reshape(-1, 4, 4, 4)
    label = np.array([r["label"] for r in rows])

    def patches(maps):
        out = np.empty((len(maps), 16, 4))
        for y in range(4):
            for x in range(4):
                out[:, y * 4 + x] = maps[:, :, max(0, y - 1) : y + 2, max(0, x - 1) : x + 2].mean(axis=(2, 3))
        return out

    train, query = patches(data[label < 2]), patches(data[label >= 8])
    model = pipeline.train(tables.maps(spark, sf_dir).where("label < 2"), EngineConfig(coreset_ratio=0.03), tables.SHAPE)
    bank = np.array([r["emb"] for r in model.bank.orderBy("bank_id").collect()])
    flat = train.reshape(-1, 4)
    assert len(bank) == round(len(flat) * 0.03) and all(np.abs(flat - b).sum(axis=1).min() < 1e-12 for b in bank)
    score = lambda p: np.sort(np.sqrt(((p[:, :, None] - bank) ** 2).sum(-1)), axis=2)[:, :, :9].mean(axis=2).max(axis=1)
    own = np.sort(score(train))
    assert model.threshold == pytest.approx(own[max(0, round(0.95 * len(own)) - 1)])
    got = [r["score"] for r in pipeline.predict(tables.maps(spark, sf_dir).where("label >= 8"), model, tables.SHAPE).orderBy("image_id").collect()]
    assert got == pytest.approx(score(query))


@pytest.mark.parametrize("name", catalogue.ORACLES)
def test_oracle(spark, sf_dir, duck, name):
    same_rows(catalogue.QUERIES[name](spark, sf_dir), duck.execute(catalogue.ORACLES[name]))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def message(*fields) -> bytes:
    """A protocol buffer: (number, int, bytes, text or list of ints)."""
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes((n & 127 | 128,)), n >> 7
        return out + bytes((n,))

    out = b""
    for number, value in fields:
        if isinstance(value, int):
            out += varint(number << 3) + varint(value)
        else:
            value = value.encode() if isinstance(value, str) else value
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


def network(copies: int, side: int, metadata: dict[str, str]) -> bytes:
    """An ONNX file: block means of the three channels, ``copies`` times over."""
    shape = lambda *dims: message((1, message((1, 1), (2, message(*((1, message((2, d) if isinstance(d, str) else (1, d))) for d in dims))))))
    ints = lambda name, *values: message((1, name), (20, 7), *((8, v) for v in values))
    pool = message((1, "x"), (2, "p"), (4, "AveragePool"), (5, ints("kernel_shape", side, side)), (5, ints("strides", side, side)))
    join = message(*((1, "p") for _ in range(copies)), (2, "y"), (4, "Concat"), (5, message((1, "axis"), (20, 2), (3, 1))))
    graph = message((1, pool), (1, join), (2, "g"), (11, message((1, "x"), (2, shape("n", 3, "h", "w")))), (12, message((1, "y"), (2, shape("n", "c", "i", "j")))))
    return message((1, 8), (8, message((1, ""), (2, 13))), (7, graph), *((14, message((1, k), (2, v))) for k, v in metadata.items()))


def test_networks(spark, folder, tmp_path):
    """A file's metadata or name say how its images are prepared, and its channels must be those that are asked for."""
    raw_mean = sample(None)[:16, :16, ::-1].mean(axis=(0, 1))
    files = {"a.onnx": {"any_preprocess": "fused", "any_precision": "int8"}, "b_fused_fp16.onnx": {}, "c.onnx": {}, "d_fused.onnx": {"any_precision": "fp32"}}
    for name, meta in files.items():
        (tmp_path / name).write_bytes(network(11, 16, meta))
    facts = {n: images.model_facts(str(tmp_path / n)) for n in files}
    assert facts == {"a.onnx": ("fused", "int8"), "b_fused_fp16.onnx": ("fused", "float16"), "c.onnx": ("standard", "float32"), "d_fused.onnx": ("standard", "float32")}
    one = images.decoded(spark, str(folder / "ok_00.PNG"))
    for name, (mode, _) in facts.items():
        extract = images.onnx_extractor(tmp_path / name)
        assert images.shape_of(extract, 64) == (33, 4, 4)
        got = images.features(one, extract, 64, channels=33).first()
        assert (got["c"], got["h"], got["w"]) == (33, 4, 4)
        want = raw_mean if mode == "fused" else (raw_mean - kernels.MEAN) / 255 / kernels.STD
        assert [got["data"][k * 16] for k in range(3)] == pytest.approx(want.tolist(), rel=1e-4)
    with pytest.raises(Exception, match="33 channels"):
        images.features(one, extract, 64, channels=32).collect()
    model = models.Model(bank=None, embed_dim=5, height=4, width=4, threshold=0.0)
    with pytest.raises(ValueError, match="channels"):
        pipeline.Scorer(model, (33, 4, 4))


def test_metadata_of_networks(tmp_path):
    """Facts are written into a file, in place of older ones, and nothing else changes."""
    from lodestone.sources import metadata

    file = tmp_path / "n.onnx"
    file.write_bytes(network(11, 16, {"author": "someone", "backbone_precision": "fp32"}))
    x = np.random.default_rng(0).random((1, 3, 64, 64), dtype=np.float32)
    before = images.onnx_extractor(file)(x)
    for size in (224, 128):
        metadata.attach(file, fused=True, precision="fp16", image_size=size, target_dim=33)
        assert images.model_metadata(str(file)) == {"author": "someone", "backbone_preprocess": "fused", "backbone_precision": "fp16", "backbone_image_size": str(size), "backbone_target_dim": "33"}
    assert images.model_facts(str(file)) == ("fused", "float16") and np.array_equal(images.onnx_extractor(file)(x), before)
    plain = network(1, 16, {})
    assert metadata.with_entries(plain, {}) == plain
    long = "x" * 300
    assert metadata.with_entries(metadata.with_entries(plain, {"k": long}), {"k": "v"}) == metadata.with_entries(plain, {"k": "v"})
    with pytest.raises(ValueError):
        metadata.with_entries(plain[:-3], {"k": "v"})


def lines_of(text):
    return {line.split()[0].rpartition("/")[2]: (line.split()[1], line.rpartition("=")[2]) for line in text.splitlines() if "score=" in line}


def test_prediction_follows_the_model(spark, tmp_path, capsys):
    """A model trained at 128 on a network is used at 128 with that network, without a word from the caller."""
    from lodestone import __main__ as command
    from lodestone.sources import samples

    samples.write(tmp_path, side=64)
    (tmp_path / "n.onnx").write_bytes(network(11, 16, {"any_preprocess": "fused"}))
    command.main(["train", "--ok", str(tmp_path / "ok"), "--ng", str(tmp_path / "ng"), "--out", str(tmp_path / "models"), "--onnx", str(tmp_path / "n.onnx"), "--embed-dim", "33", "--image-size", "128", "--patch-size", "1", "--coreset", "0.5", "--distance-metric", "SquaredEuclidean", "--cpu"])
    path = capsys.readouterr().out.strip()
    model = models.load(spark, path)
    assert (model.image_size, model.embed_dim, model.height) == (128, 33, 8)
    command.main(["predict", "--model", path, "--input", str(tmp_path / "ng"), "--cpu"])
    got = lines_of(capsys.readouterr().out)
    maps = images.features(images.decoded(spark, str(tmp_path / "ng")), images.onnx_extractor(tmp_path / "n.onnx"), 128)
    want = {r["image_id"].rpartition("/")[2]: (f"score={r['score']:.4f}", r["label"]) for r in pipeline.predict(maps, model, (33, 8, 8)).collect()}
    assert got == want and len(want) == 6
    with pytest.raises(Exception, match="channels"):
        command.main(["train", "--ok", str(tmp_path / "ok"), "--out", str(tmp_path / "models"), "--onnx", str(tmp_path / "n.onnx"), "--image-size", "64"])
    with pytest.raises(SystemExit):
        command.main(["train", "--ok", "x", "--metric", "cosine"])


def test_command_line_options(spark, tmp_path, capsys, caplog):
    from lodestone import __main__ as command
    from lodestone.sources import samples

    samples.write(tmp_path, side=64)
    options = ["--split-mode", "Count", "--ok-memory-count", "5", "--ok-tune-count", "2", "--ng-tune-count", "4", "--split-seed", "7", "--auto-search-neighbors", "false", "--neighbors", "2", "--ann", "--ann-clusters", "3", "--ann-probes", "1", "--auto-search-ann-probes", "false", "--feature-downscale", "7"]
    with caplog.at_level("INFO", logger="lodestone"):
        command.main(["train", "--data", str(tmp_path / "ok"), "--ng-data", str(tmp_path / "ng"), "--output", str(tmp_path / "m"), "--profile", "p", "--image-size", "64", "--coreset", "0.5", *options])
    path = capsys.readouterr().out.strip()
    assert any("search neighbours" in r.message for r in caplog.records) and not any("search probes" in r.message for r in caplog.records) and any("total" in r.message for r in caplog.records)
    model = models.load(spark, path)
    assert (model.num_neighbors, model.use_ann, model.ann_clusters, model.ann_probes, model.downscale) == (2, True, 3, 1, 7)
    config = profiles.load(profiles.config_path(tmp_path / "m", "p"))
    assert (config.split_mode, config.train_count, config.seed, config.search_neighbors) == ("count", 5, 7, False)
    with caplog.at_level("INFO", logger="lodestone"):
        command.main(["predict", "--model", path, "--input", str(tmp_path / "ng"), "--output", str(tmp_path / "out"), "--threshold", "1e9"])
    assert {v[1] for v in lines_of(capsys.readouterr().out).values()} == {"OK"}  # the caller's threshold
    assert any(r.message == "6 images, NG=0, OK=6" for r in caplog.records)
    rows = spark.read.parquet(str(tmp_path / "out" / "predictions")).collect()
    assert {f.name for f in (tmp_path / "out").glob("*.png")} == {f"{r['image_id'].rpartition('/')[2][:-4]}_OK_{r['score']:.4f}.png" for r in rows} and len(rows) == 6
    command.main(["predict", "--model", path, "--input", str(tmp_path / "ng"), "--output", str(tmp_path / "none"), "--no-heatmap"])
    assert not list((tmp_path / "none").glob("*.png"))


def test_command_line(spark, tmp_path, capsys):
    from lodestone import __main__ as command
    from lodestone.sources import samples

    samples.write(tmp_path, side=64)
    assert np.array_equal(samples.plate(99), samples.plate())  # the stain lies outside
    command.main(["train", "--ok", str(tmp_path / "ok"), "--ng", str(tmp_path / "ng"), "--out", str(tmp_path / "models"), "--image-size", "64", "--patch-size", "1", "--coreset", "0.5"])
    model = capsys.readouterr().out.strip()
    assert model.endswith("models/default/model") and (tmp_path / "models/default/config.json").exists()
    command.main(["predict", "--model", model, "--input", str(tmp_path)])
    lines = capsys.readouterr().out.splitlines()
    label = {line.split()[0].rpartition("/")[2]: line.rpartition("=")[2] for line in lines}
    assert len(lines) == 18 and all(v == ("NG" if k.startswith("ng_0") else "OK") for k, v in label.items())
