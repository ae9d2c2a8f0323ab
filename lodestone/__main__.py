"""Command line: ``python -m lodestone train --ok FOLDER --ng FOLDER --out FOLDER`` and ``predict --model PATH --input FOLDER``.

Prediction follows the model: image size, patches, neighbours and search are those it was trained with. Options of run time (threshold by
hand, heatmaps, GPU) are the caller's.
"""

from __future__ import annotations

import argparse
import logging
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.config import METRICS, SPLIT_MODES, EngineConfig
from lodestone.plans import pipeline, render
from lodestone.plans.progress import Progress, StageTimes, elapsed
from lodestone.shared import checkpointed
from lodestone.sources import catalog, files, images, models, profiles

log = logging.getLogger("lodestone")


def metric(text: str) -> str:
    """A metric's name, with or without capitals and underscores."""
    found = next((m for m in METRICS if m.replace("_", "") == text.lower().replace("_", "")), None)
    if found is None:
        raise argparse.ArgumentTypeError(f"metric must be one of {METRICS}")
    return found


def switch(text: str) -> bool:
    return text.strip().lower() != "false"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lodestone")
    verbs = top.add_subparsers(dest="verb", required=True)
    d = EngineConfig()
    for name in ("train", "predict"):
        p = verbs.add_parser(name, aliases=["infer"] if name == "predict" else [], allow_abbrev=False)
        p.add_argument("--onnx", "--backbone", help="feature extractor; without one, and without a backbone's id, block statistics serve")
        p.add_argument("--backbone-id", help="a backbone of the catalogue, whose file is looked for in the folder of models")
        p.add_argument("--cpu", action="store_true", help="no GPU, even if one is at hand")
        p.add_argument("--gpu-device", type=int, default=d.gpu_device)
        p.add_argument("--batch-size", type=int, default=d.batch_size)
        if name == "train":
            p.add_argument("--ok", "--data", required=True)
            p.add_argument("--ng", "--ng-data")
            p.add_argument("--out", "--output", default=d.output_dir)
            p.add_argument("--profile", default=d.profile_name)
            p.add_argument("--image-size", type=int, default=d.image_size)
            p.add_argument("--patch-size", type=int, default=d.patch_size)
            p.add_argument("--neighbors", type=int, default=d.num_neighbors)
            p.add_argument("--coreset", type=float, default=d.coreset_ratio)
            p.add_argument("--embed-dim", type=int, default=d.embed_dim, help="channels that the extractor must give")
            p.add_argument("--metric", "--distance-metric", type=metric, default=d.metric)
            p.add_argument("--feature-downscale", type=int, default=d.downscale)
            p.add_argument("--ann", action="store_true")
            p.add_argument("--ann-clusters", type=int, default=d.ann_clusters)
            p.add_argument("--ann-probes", type=int, default=d.ann_probes)
            p.add_argument("--auto-search-neighbors", type=switch, nargs="?", const=True, default=True)
            p.add_argument("--auto-search-ann-probes", type=switch, nargs="?", const=True, default=True)
            p.add_argument("--split-mode", type=str.lower, choices=SPLIT_MODES, default=d.split_mode)
            p.add_argument("--split-seed", type=int, default=d.seed)
            p.add_argument("--ok-train-ratio", type=float, default=d.train_ratio)
            p.add_argument("--ok-tune-ratio", type=float, default=d.tune_ratio)
            p.add_argument("--ok-test-ratio", type=float, default=d.test_ratio)
            p.add_argument("--ng-tune-ratio", type=float, default=d.ng_tune_ratio)
            p.add_argument("--ok-memory-count", type=int, default=d.train_count)
            p.add_argument("--ok-tune-count", type=int, default=d.tune_count)
            p.add_argument("--ng-tune-count", type=int, default=d.ng_tune_count)
        else:
            p.add_argument("--model", required=True)
            p.add_argument("--input", required=True)
            p.add_argument("--output", help="folder for the predictions (Parquet) and heatmaps (PNG); without one, rows are printed only")
            p.add_argument("--threshold", "--manual-threshold", type=float, help="goes before the model's")
            p.add_argument("--no-heatmap", action="store_true")
    return top


def extractor_of(config: EngineConfig, file: str | None, named: bool) -> images.Extractor:
    """The file given, or a catalogue's if the backbone was named, or else the plain extractor."""
    if not file and named:
        file = str(catalog.model_file(config.backbone_id, config.custom_backbone_path, config.use_gpu))
    return images.onnx_extractor(file, config.use_gpu, config.gpu_device) if file else images.block_statistics


def config_of(args) -> EngineConfig:
    """The options of training."""
    return EngineConfig(
        profile_name=args.profile, backbone_id=catalog.backbone_id(args.backbone_id) if args.backbone_id else (catalog.CUSTOM if args.onnx else catalog.DEFAULT), custom_backbone_path=args.onnx or "",
        image_size=args.image_size, patch_size=args.patch_size, num_neighbors=args.neighbors, coreset_ratio=args.coreset, embed_dim=args.embed_dim, metric=args.metric, downscale=args.feature_downscale,
        use_ann=args.ann, ann_clusters=args.ann_clusters, ann_probes=args.ann_probes, search_neighbors=args.auto_search_neighbors, ok_path=args.ok, ng_path=args.ng or "", output_dir=args.out,
        split_mode=args.split_mode, seed=args.split_seed, train_ratio=args.ok_train_ratio, tune_ratio=args.ok_tune_ratio, test_ratio=args.ok_test_ratio, ng_tune_ratio=args.ng_tune_ratio,
        train_count=args.ok_memory_count, tune_count=args.ok_tune_count, ng_tune_count=args.ng_tune_count, use_gpu=not args.cpu, gpu_device=args.gpu_device, batch_size=args.batch_size,
    )


def train(spark: SparkSession, args) -> None:
    config, steps = config_of(args), Progress(log.info)
    extract = extractor_of(config, args.onnx, bool(args.backbone_id))
    channels = config.embed_dim if extract is not images.block_statistics else None
    maps_of = lambda path: images.features(images.decoded(spark, path), extract, config.image_size, batch=config.effective_batch, channels=channels)
    with steps.step("extract"):
        maps = maps_of(args.ok).withColumn("class", F.lit("OK"))
        if args.ng:
            maps = maps.unionByName(maps_of(args.ng).withColumn("class", F.lit("NG")))
        maps = checkpointed(maps)
    done = pipeline.train_and_tune(maps, config, images.shape_of(extract, config.image_size), steps, args.auto_search_ann_probes)
    path = profiles.model_path(args.out, args.profile)
    with steps.step("save"):
        models.save(done.model, str(path))
        profiles.save(config.with_tuned(done.model.num_neighbors, done.model.ann_probes, done.model.threshold), profiles.config_path(args.out, args.profile))
    log.info("bank of %d, threshold %.6f, %d neighbours, test %s", done.model.bank.count(), done.model.threshold, done.model.num_neighbors, done.test)
    for line in steps.summary():
        log.info(line)
    print(path)


def predict(spark: SparkSession, args) -> None:
    steps, times = Progress(log.info), StageTimes(spark)
    model = models.load(spark, args.model)
    user = EngineConfig(use_gpu=not args.cpu, gpu_device=args.gpu_device, batch_size=args.batch_size, save_heatmap=not args.no_heatmap, custom_backbone_path=args.onnx or "", use_manual_threshold=args.threshold is not None, threshold=args.threshold if args.threshold is not None else EngineConfig.threshold)
    config = user.for_inference(model.options(), profiles.beside(args.model))
    # a model of the plain extractor has its few channels; any other names its backbone
    network = bool(args.onnx or args.backbone_id or config.custom_backbone_path.strip())
    extract = extractor_of(config, args.onnx or config.custom_backbone_path.strip() or None, bool(args.backbone_id))
    pictures = images.decoded(spark, args.input)
    with steps.step("extract"):
        maps = checkpointed(images.features(pictures, extract, config.image_size, batch=config.effective_batch, channels=model.embed_dim if network else None, times=times))
        if maps.isEmpty():
            raise ValueError(f"there is no image in {args.input}")
    with steps.step("score"):
        scorer = pipeline.Scorer(model, images.shape_of(extract, config.image_size), config, times)
        found = checkpointed(scorer.score_maps(maps))
    with steps.step("judge"):
        rows = checkpointed(pipeline.judged_timed(found, config.threshold, times, "scores"))
        counts = {r["label"]: r["n"] for r in pipeline.label_counts(rows).collect()}
    if args.output:
        rows.drop("scores").write.mode("overwrite").parquet(f"{args.output}/predictions")
        if config.save_heatmap:
            with steps.step("heatmap"):
                save_heatmaps(pictures, rows, scorer, Path(args.output))
    for r in rows.drop("scores").orderBy("image_id").toLocalIterator():
        print(f"{r['image_id']} score={r['score']:.4f} label={r['label']}")
    log.info("%d images, NG=%d, OK=%d", sum(counts.values()), counts.get("NG", 0), counts.get("OK", 0))
    for line in [*steps.summary(), " | ".join(f"{stage} {elapsed(1000 * s)}" for stage, s in times.seconds().items()) + " on all workers"]:
        log.info(line)


def save_heatmaps(pictures: DataFrame, rows: DataFrame, scorer: pipeline.Scorer, folder: Path) -> None:
    """Draws and writes on the workers."""
    _, h, w = scorer.shape
    f = scorer.model.downscale
    files.write(render.heatmaps(pictures, rows.withColumnRenamed("image_id", "path"), h // f, w // f, scorer.times), str(folder.absolute()))


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(message)s")
    spark = SparkSession.builder.appName("lodestone").getOrCreate()
    (train if args.verb == "train" else predict)(spark, args)
    return 0


if __name__ == "__main__":
    sys.exit(main())
