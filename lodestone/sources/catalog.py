"""Backbone catalogue and choice of model file variants."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources import paths

DEFAULT, CUSTOM = "wide_resnet50_2", "custom"

#: (id, name, file). Fixed values.
BACKBONES = [
    ("wide_resnet50_2", "WideResNet-50", "models/wide_resnet50_2_features.onnx"),
    ("wide_resnet101_2", "WideResNet-101", "models/wide_resnet101_2_features.onnx"),
    ("resnet50", "ResNet-50", "models/resnet50_features.onnx"),
    ("resnet101", "ResNet-101", "models/resnet101_features.onnx"),
    ("resnet18", "ResNet-18", "models/resnet18_features.onnx"),
    ("efficientnet_b0", "EfficientNet-B0", "models/efficientnet_b0_features.onnx"),
    ("mobilenet_v3_large", "MobileNet-V3-Large", "models/mobilenet_v3_large_features.onnx"),
    ("mobilenet_v3_small", "MobileNet-V3-Small", "models/mobilenet_v3_small_features.onnx"),
    ("custom", "Custom ONNX", ""),
]

#: Other spellings of ids. Fixed values.
ALIASES = {"wideresnet50": "wide_resnet50_2", "wrn50": "wide_resnet50_2"}

#: File name endings in order of preference. Fixed values.
GPU_ORDER = ["_fused_fp16", "_fused", "", "_fused_fp16_int8", "_fused_int8"]
CPU_ORDER = ["_fused_int8", "_fused_fp16_int8", "_fused_fp16", "_fused", ""]


def catalog(spark: SparkSession) -> DataFrame:
    """The catalogue as rows: backbone_id, name, file, and its place."""
    return spark.createDataFrame([(k, *b) for k, b in enumerate(BACKBONES)], "place int, backbone_id string, name string, file string")


def resolved(ids: DataFrame, id_col: str) -> DataFrame:
    """Adds ``backbone_id``, ``name`` and ``file`` for an id in any case; the default backbone for an unknown or null one."""
    known = F.broadcast(catalog(ids.sparkSession).select(F.lower("backbone_id").alias("_key"), "backbone_id", "name", "file"))  # nine rows
    default = next(b for b in BACKBONES if b[0] == DEFAULT)
    out = ids.join(known, F.lower(F.trim(id_col)) == F.col("_key"), "left").drop("_key")
    for k, c in enumerate(("backbone_id", "name", "file")):
        out = out.withColumn(c, F.coalesce(c, F.lit(default[k])))
    return out


def backbone_id(name: str) -> str:
    """An id from an id or alias in any case; an unknown one is an error."""
    key = name.strip().lower()
    key = ALIASES.get(key, key)
    if key not in {b[0] for b in BACKBONES}:
        raise ValueError(f"there is no backbone {name}")
    return key


def variant_names(stem: str, prefer_gpu: bool = False) -> list[str]:
    return [f"{stem}{end}.onnx" for end in (GPU_ORDER if prefer_gpu else CPU_ORDER)]


def preferred_variants(stems: DataFrame, files: DataFrame, stem_col: str = "stem", file_col: str = "file", prefer_gpu: bool = False) -> DataFrame:
    """Per stem: ``choice``, the first existing variant in order of preference, else the plain file."""
    order = GPU_ORDER if prefer_gpu else CPU_ORDER
    wanted = stems.select(stem_col, F.posexplode(F.array(*(F.concat(F.col(stem_col), F.lit(f"{e}.onnx")) for e in order))).alias("_rank", "_file"))
    there = wanted.join(files.select(F.col(file_col).alias("_file")).distinct(), "_file", "left_semi")
    best = there.groupBy(stem_col).agg(F.min_by("_file", "_rank").alias("choice"))
    return stems.select(stem_col).distinct().join(best, stem_col, "left").withColumn("choice", F.coalesce("choice", F.concat(F.col(stem_col), F.lit(".onnx"))))


def preferred_file(base: str | Path, prefer_gpu: bool = False) -> Path:
    """The driver's form of the same choice, for one model file."""
    import re

    from lodestone.functions.scalars import VARIANT_SUFFIXES

    base = Path(base)
    stem = re.sub(f"(?i)({'|'.join(VARIANT_SUFFIXES)})$", "", base.stem)
    return next((base.parent / n for n in variant_names(stem, prefer_gpu) if (base.parent / n).exists()), base)


def model_file(backbone: str, custom: str = "", prefer_gpu: bool = False, start: str | Path = ".") -> Path:
    """The file of a backbone: the custom one, or the preferred variant of the catalogue's that is there."""
    key = backbone_id(backbone)
    if key == CUSTOM:
        if not custom.strip():
            raise ValueError("a custom backbone needs a file")
        return preferred_file(paths.resolved(custom, start), prefer_gpu)
    return preferred_file(paths.resolved(next(b[2] for b in BACKBONES if b[0] == key), start), prefer_gpu)


def status(backbone: str, custom: str = "", prefer_gpu: bool = False, start: str | Path = ".") -> str:
    """Whether a backbone's file is there, in words."""
    try:
        file = model_file(backbone, custom, prefer_gpu, start)
    except ValueError as problem:
        return str(problem)
    if not file.exists():
        return f"missing: {file.name}"
    slow = " (int8 may be slower on a GPU; float16 is the better choice)" if prefer_gpu and "_int8" in file.name.lower() else ""
    return f"ready: {file.name}{slow}"


def by_file(file: str | Path, prefer_gpu: bool = False, start: str | Path = ".") -> str:
    """The backbone whose file this is; ``custom`` for any other."""
    wanted = str(paths.resolved(file, start)).lower()
    return next((b[0] for b in BACKBONES if b[0] != CUSTOM and str(model_file(b[0], "", prefer_gpu, start)).lower() == wanted), CUSTOM)


def export_file(backbone: str, folder: str | Path, fused: bool = True, fp16: bool = False, int8: bool = False) -> Path:
    """Where an exported model of a backbone is put."""
    file = next((b[2] for b in BACKBONES if b[0] == backbone.lower()), BACKBONES[0][2])
    return Path(folder) / f"{Path(file).stem}{'_fused' * fused}{'_fp16' * fp16}{'_int8' * int8}.onnx"


def precision(file: Column) -> Column:
    """A model file's precision as its name tells it."""
    name = F.lower(file)
    return F.when(name.contains("int8"), "int8").when(name.contains("fp16"), "float16").otherwise("float32")
