"""Options of training and inference, their validation, merging and storage shape."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields, replace

METRICS = ("euclidean", "squared_euclidean")
SPLIT_MODES = ("ratio", "count")
#: Least and greatest embedding dimension. Fixed values.
EMBED = (32, 4096)

#: Names in stored profiles and models, by option. Other tools read these documents.
STORED = {
    "profile_name": "ProfileName", "backbone_id": "BackboneId", "custom_backbone_path": "CustomBackboneOnnxPath", "backbone_path": "BackboneOnnxPath",
    "image_size": "ImageSize", "patch_size": "PatchSize", "num_neighbors": "NumNeighbors", "coreset_ratio": "CoresetRatio", "embed_dim": "TargetEmbedDimension",
    "threshold": "AnomalyThreshold", "use_manual_threshold": "UseManualThreshold", "ok_path": "OkDataPath", "ng_path": "NgDataPath",
    "train_ratio": "OkTrainRatio", "tune_ratio": "OkTuneRatio", "test_ratio": "OkTestRatio", "ng_tune_ratio": "NgTuneRatio", "split_mode": "SplitMode",
    "train_count": "OkMemoryCount", "tune_count": "OkTuneCount", "ng_tune_count": "NgTuneCount", "seed": "SplitSeed", "output_dir": "ModelOutputDir",
    "search_neighbors": "AutoSearchNeighbors", "use_gpu": "UseGpu", "gpu_device": "GpuDeviceId", "batch_size": "InferenceBatchSize", "parallelism": "PreprocessParallelism",
    "save_heatmap": "SaveHeatmap", "metric": "DistanceMetric", "use_simd": "UseSimdDistance", "patch_parallelism": "PatchScoreParallelism",
    "downscale": "FeatureMapDownscale", "use_ann": "UseApproximateNearestNeighbors", "ann_clusters": "AnnClusterCount", "ann_probes": "AnnProbeClusters",
}

#: Older names of options, tried in order where the option itself is blank. Fixed values.
LEGACY = {"ok_path": ["OkTrainPath", "OkTunePath"], "ng_path": ["NgTunePath"], "output_dir": ["ModelOutputPath", "InferModelPath"]}


def clamp(value, low, high):
    return max(low, min(high, value))


@dataclass(frozen=True)
class EngineConfig:
    """All options, validated when made. A wrong value raises ``ValueError``."""

    profile_name: str = "default"
    backbone_id: str = "wide_resnet50_2"
    custom_backbone_path: str = ""
    backbone_path: str = "models/wide_resnet50_2_features.onnx"
    image_size: int = 224
    patch_size: int = 3
    num_neighbors: int = 9
    coreset_ratio: float = 0.1
    embed_dim: int = 1024
    threshold: float = 0.5
    use_manual_threshold: bool = False
    ok_path: str = "data/ok"
    ng_path: str = "data/ng"
    train_ratio: float = 0.6
    tune_ratio: float = 0.2
    test_ratio: float = 0.2
    ng_tune_ratio: float = 0.5
    split_mode: str = "ratio"
    train_count: int = 6
    tune_count: int = 2
    ng_tune_count: int = 3
    seed: int = 42
    output_dir: str = "models"
    search_neighbors: bool = True
    use_gpu: bool = True
    gpu_device: int = 0
    batch_size: int = 8
    parallelism: int = 0
    save_heatmap: bool = True
    metric: str = "squared_euclidean"
    use_simd: bool = True
    patch_parallelism: int = 0
    downscale: int = 1
    use_ann: bool = False
    ann_clusters: int = 32
    ann_probes: int = 4

    def __post_init__(self):
        def need(ok: bool, what: str) -> None:
            if not ok:
                raise ValueError(what)

        need(64 <= self.image_size <= 1024, "image size must be 64 to 1024")
        need(self.patch_size >= 1 and self.patch_size % 2 == 1, "patch size must be odd and 1 or more")
        need(self.num_neighbors >= 1, "neighbours must be 1 or more")
        need(0 < self.coreset_ratio <= 1, "coreset ratio must be over 0 and up to 1")
        need(EMBED[0] <= self.embed_dim <= EMBED[1], "embedding dimension must be 32 to 4096")
        need(1 <= self.downscale <= 8, "downscale must be 1 to 8")
        need(self.metric in METRICS, f"metric must be one of {METRICS}")
        need(self.ann_clusters >= 2, "clusters must be 2 or more")
        need(self.ann_probes >= 1, "probes must be 1 or more")
        need(self.split_mode in SPLIT_MODES, f"split mode must be one of {SPLIT_MODES}")
        need(self.split_mode != "count" or self.train_count >= 1, "a count split needs a training image")

    @property
    def effective_batch(self) -> int:
        return clamp(self.batch_size if self.batch_size > 0 else 8, 1, 64)

    def with_tuned(self, num_neighbors: int, ann_probes: int, threshold: float) -> EngineConfig:
        return replace(self, num_neighbors=num_neighbors, ann_probes=ann_probes, threshold=threshold)

    def for_inference(self, model: dict, sibling: EngineConfig | None = None) -> EngineConfig:
        """The model's algorithmic options with this configuration's run-time options. A model without a metric was made with ``euclidean``.

        ``sibling`` is the profile that lies beside the model: it tells the backbone that the model doesn't name, and a custom
        backbone's file that this configuration doesn't. The threshold is this configuration's only if it is to be used by hand.
        """
        kept = ("image_size", "patch_size", "num_neighbors", "coreset_ratio", "downscale", "use_ann", "ann_clusters", "ann_probes")
        found = {k: model[k] for k in kept if model.get(k) is not None}
        if EMBED[0] <= (model.get("embed_dim") or 0) <= EMBED[1]:  # the plain extractor has fewer channels than a network may have
            found["embed_dim"] = model["embed_dim"]
        found["backbone_id"] = (model.get("backbone_id") or "").strip() or (sibling or self).backbone_id
        found["custom_backbone_path"] = self.custom_backbone_path.strip() or (sibling or self).custom_backbone_path
        if not self.use_manual_threshold and model.get("threshold") is not None:
            found["threshold"] = model["threshold"]
        return replace(self, **found, metric=model.get("metric") or "euclidean")

    def stored(self) -> dict:
        """The document that a profile holds: metric and split mode as numbers."""
        out = {STORED[k]: v for k, v in asdict(self).items()}
        return out | {"DistanceMetric": METRICS.index(self.metric), "SplitMode": SPLIT_MODES.index(self.split_mode)}

    @classmethod
    def from_stored(cls, document: dict) -> EngineConfig:
        """The configuration in a profile: unknown keys are passed over, older names honoured, split ratios normalised."""
        out = {f.name: document[STORED[f.name]] for f in fields(cls) if STORED[f.name] in document}
        for name, older in LEGACY.items():
            if not str(out.get(name) or "").strip():
                found = next((document[k] for k in older if str(document.get(k) or "").strip()), None)
                out.pop(name, None)
                if found is not None:
                    out[name] = found
        if isinstance(out.get("metric"), int):
            out["metric"] = METRICS[out["metric"]]
        if isinstance(out.get("split_mode"), int):
            out["split_mode"] = SPLIT_MODES[out["split_mode"]]
        names = ("train_ratio", "tune_ratio", "test_ratio")
        out |= dict(zip(names, normalised_ratios([out.get(k, getattr(cls, k)) for k in names]), strict=True))
        out["ng_tune_ratio"] = clamp(out.get("ng_tune_ratio", cls.ng_tune_ratio), 0.05, 0.95)
        return cls(**out)


def normalised_ratios(ratios: list[float]) -> list[float]:
    """Negative ratios are 0; a sum of 0 gives .6/.2/.2; a sum off 1 by over .001 is scaled to 1."""
    ratios = [max(0.0, r) for r in ratios]
    total = sum(ratios)
    if total <= 0:
        return [0.6, 0.2, 0.2]
    return ratios if abs(total - 1) <= 0.001 else [r / total for r in ratios]
