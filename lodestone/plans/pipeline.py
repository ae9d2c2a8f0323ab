"""Training, tuning and prediction over feature maps (``image_id``, ``data``)."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from lodestone.config import EngineConfig
from lodestone.operators import coreset, features, ivf, knn, ordered, split, tuning
from lodestone.plans.batch import Batch
from lodestone.plans.progress import Progress, untimed
from lodestone.shared import checkpointed, ship
from lodestone.sources.models import Model

KEYS = ["image_id", "patch_idx"]


@dataclass
class Trained:
    """A model, the splits' sizes, and the metrics of the searches that ran."""

    model: Model
    neighbor_sweep: list[dict] = field(default_factory=list)
    probe_sweep: list[dict] = field(default_factory=list)
    test: dict | None = None


class Scorer:
    """Scores maps against a model; an index is built once if it is asked for and the bank is large enough."""

    def __init__(self, model: Model, shape: tuple[int, int, int], config: EngineConfig | None = None, times=untimed):
        """Searches as ``config`` says, or else as the model does; the metric is always the model's. ``times`` (``progress.StageTimes``) sums what its stages take."""
        if config is not None:
            model = replace(model, downscale=config.downscale, use_ann=config.use_ann, ann_clusters=config.ann_clusters, ann_probes=config.ann_probes)
        self.times = times
        if shape[0] != model.embed_dim:
            raise ValueError(f"the maps have {shape[0]} channels, the model {model.embed_dim}")
        self.model, self.shape = model, shape
        self.index = self.shared = None
        if model.use_ann and ivf.uses_index(True, model.bank.count(), model.ann_clusters):
            indexed, centroids = ivf.build(model.bank, model.ann_clusters)
            self.index = checkpointed(indexed), centroids

    def patches(self, maps: DataFrame) -> DataFrame:
        m = self.model
        return features.patches(maps, "image_id", "data", self.shape, m.patch_size, m.downscale, self.times)

    def _share(self) -> None:
        if self.shared is None:  # one broadcast serves all searches and micro-batches
            self.shared = ivf.shared_cells(*self.index) if self.index else knn.shared_bank(self.model.bank)

    def neighbours(self, maps: DataFrame, k: int | None = None, probes: int | None = None, means: knn.Means | None = None) -> DataFrame:
        m, k = self.model, k or self.model.num_neighbors
        self._share()
        if self.index:
            return ivf.nearest_probed(self.patches(maps), KEYS, *self.index, k, probes or m.ann_probes, shared=self.shared, means=means, times=self.times)
        return knn.nearest(self.patches(maps), KEYS, m.bank, k, shared=self.shared, means=means, times=self.times)

    def patch_scores(self, maps: DataFrame, k: int | None = None, probes: int | None = None) -> DataFrame:
        """Per image and patch: ``dist``."""
        return self.neighbours(maps, k, probes, knn.Means(self.model.metric, (k or self.model.num_neighbors,)))

    def scores(self, maps: DataFrame, k: int | None = None, probes: int | None = None) -> DataFrame:
        """Per image: ``score``."""
        return knn.image_scores(self.patch_scores(maps, k, probes))

    def probed_scores(self, maps: DataFrame, k: int, probes: list[int], name: str) -> DataFrame:
        """Per image and number of probes (``name``): ``score``."""
        self._share()
        if self.index and (self.shared is None or self.shared.value.whole.tree is None):  # boxes of few dimensions are quicker one by one
            return knn.image_scores(ivf.swept(self.patches(maps), KEYS, *self.index, k, probes, self.model.metric, name, shared=self.shared, times=self.times), by=[name])
        return tuning.each(name, probes, lambda p: self.scores(maps, k, p))

    def score_maps(self, maps: DataFrame) -> DataFrame:
        """Per image: ``score`` and ``scores``, its patches' in order, for heatmaps."""
        _, h, w = self.shape
        f = self.model.downscale
        return features.score_map(self.patch_scores(maps), "image_id", h // f, w // f).withColumn("score", F.array_max("scores"))


def train(maps: DataFrame, config: EngineConfig, shape: tuple[int, int, int], seed: int = 0, progress: Progress | None = None) -> Model:
    """A model of normal maps: patches (not downscaled), their coreset, and the 95th percentile of the maps' own scores as threshold."""
    return _trained(maps, config, shape, seed, progress).model


def _trained(maps: DataFrame, config: EngineConfig, shape: tuple[int, int, int], seed: int = 0, progress: Progress | None = None) -> Scorer:
    """The scorer of a new model: its index and what it has broadcast serve further searches."""
    c, h, w = shape
    found = features.patches(maps, "image_id", "data", shape, config.patch_size)
    if found.isEmpty():
        raise ValueError("there is no image to train on")
    bank = found.select((F.col("image_id").cast("long") * (h * w) + F.col("patch_idx")).alias("bank_id"), "emb") if dict(maps.dtypes)["image_id"] in ("bigint", "int") else found.select(F.xxhash64("image_id", "patch_idx").alias("bank_id"), "emb")
    picked = checkpointed(coreset.sample(bank, config.coreset_ratio, seed, report=(progress or Progress()).counter("coreset")))
    members = picked.select(F.col("pick").cast("long").alias("bank_id"), "emb")
    model = Model(
        bank=members, embed_dim=c, height=h, width=w, threshold=0.0, patch_size=config.patch_size, num_neighbors=config.num_neighbors, coreset_ratio=config.coreset_ratio, image_size=config.image_size,
        backbone_id=config.backbone_id, metric=config.metric, downscale=config.downscale, use_ann=config.use_ann, ann_clusters=config.ann_clusters, ann_probes=config.ann_probes,
    )
    scorer = Scorer(model, shape)
    own = checkpointed(scorer.scores(maps))
    scorer.model = model.tuned(model.num_neighbors, model.ann_probes, ordered.p95(own, "score"))
    return scorer


def search_neighbors(scorer: Scorer, labelled: DataFrame, candidates=tuning.NEIGHBOR_CANDIDATES) -> list[dict]:
    """The best threshold for every k, from one list of the most neighbours: the nearest k are its first."""
    name = "num_neighbors"
    ks = tuning.candidates_of(name, candidates)
    distances = scorer.neighbours(labelled, max(ks), means=knn.Means(scorer.model.metric, tuple(ks), name))
    scored = knn.image_scores(distances, by=[name]).join(labelled.select("image_id", "class"), "image_id")
    return [r.asDict() for r in tuning.best_threshold(scored, [name]).collect()]


def search_probes(scorer: Scorer, labelled: DataFrame, k: int, candidates=None) -> list[dict]:
    """The best threshold for every number of probes; their scores are one table."""
    name = "ann_probes"
    found = scorer.probed_scores(labelled, k, tuning.candidates_of(name, tuning.probe_candidates(scorer.model.ann_clusters, candidates)), name)
    scored = found.join(labelled.select("image_id", "class"), "image_id")
    return [r.asDict() for r in tuning.best_threshold(scored, [name]).collect()]


def train_and_tune(maps: DataFrame, config: EngineConfig, shape: tuple[int, int, int], progress: Progress | None = None, search_probe_counts: bool = True) -> Trained:
    """Splits maps (``image_id``, ``data``, ``class``), trains on normal ones, then searches k and, with an index, probes on
    the tuning part, and evaluates on the test part. A search without both classes is left out and keeps the trained values."""
    steps = progress or Progress()
    counts = (config.train_count, config.tune_count, config.ng_tune_count) if config.split_mode == "count" else None
    with steps.step("split"):
        parts = checkpointed(split.split(maps.select("image_id", "data", "class"), "image_id", "class", config.seed, (config.train_ratio, config.tune_ratio, config.test_ratio), config.ng_tune_ratio, counts))
    with steps.step("train"):
        scorer = _trained(parts.where("subset = 'train' and class = 'OK'"), config, shape, progress=steps)
        model = scorer.model
        out = Trained(model)
    if split.can_tune(parts):
        tune = parts.where("subset = 'tune'")
        ks = tuning.NEIGHBOR_CANDIDATES if config.search_neighbors else [config.num_neighbors]
        with steps.step("search neighbours"):
            out.neighbor_sweep = search_neighbors(scorer, tune, ks)
        best = tuning.best_neighbors(out.neighbor_sweep)
        k, threshold, probes = best["num_neighbors"], best["threshold"], model.ann_probes
        if scorer.index and search_probe_counts:
            with steps.step("search probes"):
                out.probe_sweep = search_probes(scorer, tune, k)
            best = tuning.best_probes(out.probe_sweep)
            probes, threshold = best["ann_probes"], best["threshold"]
        out.model = scorer.model = model.tuned(k, probes, threshold)
    if split.can_test(parts):
        with steps.step("test"):
            test = parts.where("subset = 'test'")
            scored = scorer.scores(test).join(test.select("image_id", "class"), "image_id")
            out.test = tuning.confusion(scored, out.model.threshold).first().asDict()
    return out


def judged(scored: DataFrame, threshold: float, *more: str) -> DataFrame:
    """Scores with ``is_anomaly`` and ``label``."""
    limit = F.lit(float(threshold))
    return scored.select("image_id", "score", tuning.is_anomaly(F.col("score"), limit).alias("is_anomaly"), tuning.label(F.col("score"), limit).alias("label"), *more)


def judged_timed(scored: DataFrame, threshold: float, times, *more: str) -> DataFrame:
    """As ``judged``, in a worker's kernel that tells ``times`` what it took."""
    ship(scored.sparkSession)
    rows = scored.select("image_id", "score", *more)
    names = ["image_id", "score", "is_anomaly", "label", *more]

    def run(batches):
        for batch in batches:
            with times("judge"):
                over = pc.greater(batch.column(1), float(threshold))
                labels = pc.if_else(over, "NG", "OK")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), over, labels, *batch.columns[2:]], names=names)

    kinds = rows.schema
    return rows.mapInArrow(run, StructType([kinds["image_id"], kinds["score"], StructField("is_anomaly", BooleanType()), StructField("label", StringType()), *(kinds[c] for c in more)]))


def predict(maps: DataFrame, model: Model, shape: tuple[int, int, int], manual_threshold: float | None = None, scorer: Scorer | None = None) -> DataFrame:
    """Per image: ``image_id``, ``score``, ``is_anomaly`` and ``label``. A given threshold goes before the model's."""
    return judged((scorer or Scorer(model, shape)).scores(maps), model.threshold if manual_threshold is None else manual_threshold)


def predict_with_maps(maps: DataFrame, model: Model, shape: tuple[int, int, int], manual_threshold: float | None = None, scorer: Scorer | None = None) -> DataFrame:
    """As ``predict``, with ``scores`` of the patches, from which ``render.heatmaps`` draws."""
    return judged((scorer or Scorer(model, shape)).score_maps(maps), model.threshold if manual_threshold is None else manual_threshold, "scores")


def predict_batch(maps: DataFrame, model: Model, shape: tuple[int, int, int], folder: str, manual_threshold: float | None = None, parts: int = 8) -> Batch:
    """``predict`` in parts, with its rows in ``folder``: run it, cancel it from any thread, and run it again to score what is left."""
    scorer = Scorer(model, shape)
    return Batch(maps, lambda part: predict(part, model, shape, manual_threshold, scorer), folder, parts)


def label_counts(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
