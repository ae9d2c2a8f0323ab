"""Models: a bank as Parquet beside one row of options, and the JSON document for interchange."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.config import METRICS
from lodestone.shared import removed, shared_folder

#: Names in the document, by field. Fixed values.
DOCUMENT = {
    "version": "Version", "backbone_id": "BackboneId", "image_size": "ImageSize", "patch_size": "PatchSize", "num_neighbors": "NumNeighbors", "coreset_ratio": "CoresetRatio",
    "embed_dim": "TargetEmbedDimension", "height": "FeatureHeight", "width": "FeatureWidth", "threshold": "AnomalyThreshold", "metric": "DistanceMetric",
    "downscale": "FeatureMapDownscale", "use_ann": "UseApproximateNearestNeighbors", "ann_clusters": "AnnClusterCount", "ann_probes": "AnnProbeClusters",
}


@dataclass(frozen=True)
class Model:
    """A trained bank (``bank_id``, ``emb``) and its options. ``height`` and ``width`` are those of unscaled maps."""

    bank: DataFrame
    embed_dim: int
    height: int
    width: int
    threshold: float
    patch_size: int = 3
    num_neighbors: int = 9
    coreset_ratio: float = 0.1
    image_size: int = 224
    backbone_id: str | None = None
    metric: str = "euclidean"
    downscale: int = 1
    use_ann: bool = False
    ann_clusters: int = 32
    ann_probes: int = 4
    version: int = 1

    def options(self) -> dict:
        return {k: getattr(self, k) for k in DOCUMENT}

    def tuned(self, num_neighbors: int, ann_probes: int, threshold: float) -> Model:
        return replace(self, num_neighbors=num_neighbors, ann_probes=ann_probes, threshold=threshold)


def checked(model: Model) -> Model:
    """The model, if its bank has rows and they all have its width."""
    sizes = model.bank.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("emb")).alias("low"), F.max(F.size("emb")).alias("high")).first()
    if not sizes["n"]:
        raise ValueError("the model's bank is empty")
    if sizes["low"] < 1 or (sizes["low"], sizes["high"]) != (model.embed_dim, model.embed_dim):
        raise ValueError(f"the bank's vectors have {sizes['low']} to {sizes['high']} values; the model says {model.embed_dim}")
    return model


def save(model: Model, path: str) -> None:
    """Writes ``bank`` as Parquet and ``options`` as JSON below the path."""
    model.bank.select("bank_id", "emb").write.mode("overwrite").parquet(f"{path}/bank")
    spark = model.bank.sparkSession
    spark.createDataFrame([(json.dumps(model.options()),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/options")


def load(spark: SparkSession, path: str) -> Model:
    if path.rstrip("/").lower().endswith("config.json"):
        raise ValueError("config.json is a profile, not a model")
    options = json.loads(spark.read.text(f"{path}/options").first()[0])
    return checked(Model(bank=spark.read.parquet(f"{path}/bank"), **options))


def to_document(model: Model) -> str:
    """The JSON document, with the whole bank: for banks that fit on the driver."""
    rows = [list(r[0]) for r in model.bank.orderBy("bank_id").select("emb").collect()]
    options = {DOCUMENT[k]: v for k, v in model.options().items()}
    return json.dumps(options | {"DistanceMetric": METRICS.index(model.metric), "MemoryBank": rows}, indent=2)


def from_document(spark: SparkSession, text: str) -> Model:
    """A model from its JSON document; without a metric it is ``euclidean``."""
    document = json.loads(text)
    options = _options(document)
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(document.get("MemoryBank") or [])]
    return checked(Model(bank=spark.createDataFrame(rows, "bank_id long, emb array<float>"), **options))


def _options(document: dict) -> dict:
    options = {k: document[n] for k, n in DOCUMENT.items() if n in document}
    options["metric"] = METRICS[options["metric"]] if isinstance(options.get("metric"), int) else options.get("metric") or "euclidean"
    return options


def read_document(spark: SparkSession, path: str) -> Model:
    """A model from a file with its JSON document, whose bank the workers read.

    The file is split at closing brackets, so each piece ends one vector of the bank, wherever Spark cuts the file. Pieces that are not all numbers
    are the options, and only these come to the driver; an option's text may hold brackets, but not two closing ones with nothing or numbers between. Vectors are numbered in the file's order by the pieces before theirs: one count for each split.
    """
    pieces = spark.read.option("lineSep", "]").text(path).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    plain = F.col("value").rlike(r"^[-+0-9.eE,\s\[]*$")
    first = r'"MemoryBank"\s*:\s*\[\s*\[([-+0-9.eE,\s]+)$'  # of the bank: behind options, in one piece with them
    vector = F.when(plain, F.regexp_extract("value", r"\[([-+0-9.eE,\s]+)$", 1)).otherwise(F.regexp_extract("value", first, 1))
    texts = [r["value"] for r in pieces.where(~plain).orderBy("block", "at").select(F.regexp_replace("value", first, '"MemoryBank": [').alias("value")).collect()]
    document = json.loads("]".join(texts))
    rows = pieces.where(F.length(F.trim(vector)) > 0).select("block", "at", F.split(vector, ",").cast("array<float>").alias("emb"))
    counts = rows.groupBy("block").count().orderBy("block").collect()  # a row for each split of the file
    before = [(r["block"], sum(c["count"] for c in counts[:k])) for k, r in enumerate(counts)]
    starts = spark.createDataFrame(before, "block long, before long")
    inside = F.row_number().over(Window.partitionBy("block").orderBy("at")) - 1
    numbered = rows.withColumn("inside", inside).join(F.broadcast(starts), "block").select((F.col("before") + F.col("inside")).alias("bank_id"), "emb")
    return checked(Model(bank=numbered, **_options(document)))


def write_document(model: Model, path: str) -> None:
    """Writes the model's JSON document as one file: the workers write the bank's parts in order, and these are joined as streams."""
    spark = model.bank.sparkSession
    folder = f"{shared_folder(spark)}/document-{uuid.uuid4().hex}"
    first = model.bank.agg(F.min("bank_id")).first()[0]
    comma = F.when(F.col("bank_id") == F.lit(first), F.lit("")).otherwise(F.lit(","))
    model.bank.orderBy("bank_id").select(F.concat(comma, F.to_json("emb")).alias("value")).write.text(folder)
    head = {DOCUMENT[k]: v for k, v in model.options().items()} | {"DistanceMetric": METRICS.index(model.metric)}
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    store = at(folder).getFileSystem(conf)
    out = at(path).getFileSystem(conf).create(at(path), True)
    try:
        out.write(bytearray((json.dumps(head)[:-1] + ', "MemoryBank": [\n').encode()))
        for part in sorted(str(f.getPath()) for f in store.listStatus(at(folder)) if f.getPath().getName().startswith("part-")):
            source = store.open(at(part))
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
            source.close()
        out.write(bytearray(b"]}"))
    finally:
        out.close()
    removed(spark, folder)
