"""The engine's registered queries, each with SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.config import EngineConfig
from lodestone.functions import maps, scalars
from lodestone.functions.vectors import squared_l2
from lodestone.operators import coreset, features, ivf, knn, ordered, split, tuning
from lodestone.plans import pipeline, render
from lodestone.shared import checkpointed, read
from lodestone.sources import catalog, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

K = 9
CLUSTERS, PROBES = 8, 4
MANUAL = 1.15


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# ---- shared SQL -------------------------------------------------------------------------------------------------------------------

D2 = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))"
MAPS = "maps AS (SELECT vec_id AS image_id, embedding AS data, label, CASE WHEN label < 8 THEN 'OK' ELSE 'NG' END AS class FROM embeddings)"
CELLS = f"{MAPS}, cells AS (SELECT image_id, label, i // 16 AS c, (i % 16) // 4 AS y, i % 4 AS x, data[i + 1]::DOUBLE AS v FROM maps, range(64) t(i))"
BANK = f"{MAPS}, bank AS (SELECT image_id AS bank_id, data AS emb FROM maps WHERE class = 'OK')"


def sql_near(queries: str, k: int = K, bank: str = "bank") -> str:
    """CTE near: the k nearest rows of ``bank`` for each row of the CTE ``queries``."""
    return f"""pairs AS (SELECT q.image_id, b.bank_id, {D2.format(a="q.emb", b="b.emb")} AS d2 FROM {queries} q, {bank} b),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY d2, bank_id) AS rank FROM pairs) WHERE rank <= {k})"""


PATCHES = f"""{CELLS}, means AS (SELECT a.image_id, a.label, a.c, a.y, a.x, avg(b.v) AS v FROM cells a JOIN cells b ON a.image_id = b.image_id AND a.c = b.c AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1
GROUP BY a.image_id, a.label, a.c, a.y, a.x),
patches AS (SELECT image_id, label, y * 4 + x AS patch_idx, max(CASE WHEN c = 0 THEN v END) AS e0, max(CASE WHEN c = 1 THEN v END) AS e1, max(CASE WHEN c = 2 THEN v END) AS e2, max(CASE WHEN c = 3 THEN v END) AS e3 FROM means GROUP BY image_id, label, y, x)"""
D4 = "((q.e0 - b.e0) * (q.e0 - b.e0) + (q.e1 - b.e1) * (q.e1 - b.e1) + (q.e2 - b.e2) * (q.e2 - b.e2) + (q.e3 - b.e3) * (q.e3 - b.e3))"


def sql_patch_scores(queries: str, bank: str, out: str) -> str:
    """CTE ``out`` (image_id, patch_idx, dist) of patch rows against bank rows."""
    return f"""{out} AS (SELECT image_id, patch_idx, list_avg(list_transform(least_d2, lambda x: sqrt(x))) AS dist
  FROM (SELECT q.image_id, q.patch_idx, min({D4}, {K}) AS least_d2 FROM {queries} q, {bank} b GROUP BY q.image_id, q.patch_idx))"""


def sql_scores(k: int = K) -> str:
    """CTEs up to ``scores`` (image_id, class, score): all images against the bank."""
    return f"""{BANK}, q AS (SELECT image_id, class, data AS emb FROM maps),
{sql_near("q", k)},
scores AS (SELECT image_id, class, round(avg(sqrt(d2)), 6) AS score FROM near JOIN q USING (image_id) GROUP BY image_id, class)"""


RATES = """CASE WHEN tp + tn + fp + fn > 0 THEN (tp + tn)::DOUBLE / (tp + tn + fp + fn) ELSE 0.0 END AS accuracy, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0.0 END AS precision,
CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0.0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN (2 * tp)::DOUBLE / (2 * tp + fp + fn) ELSE 0.0 END AS f1"""
COUNTS = """count(*) FILTER (class = 'NG' AND score > threshold) AS tp, count(*) FILTER (class = 'OK' AND score <= threshold) AS tn,
count(*) FILTER (class = 'OK' AND score > threshold) AS fp, count(*) FILTER (class = 'NG' AND score <= threshold) AS fn"""


def sql_best(scores: str) -> str:
    """A query for the best threshold over a CTE of scores, by brute force over all candidates."""
    return f"""(SELECT threshold, tp, tn, fp, fn, {RATES} FROM (
  SELECT kind, threshold, {COUNTS} FROM (
    SELECT 0 AS kind, (s + nx) / 2 AS threshold FROM (SELECT s, lead(s) OVER (ORDER BY s) AS nx FROM (SELECT DISTINCT score AS s FROM {scores})) WHERE nx IS NOT NULL
    UNION ALL SELECT 0, (min(score) + (min(score) + 1e-4)) / 2 FROM {scores} HAVING min(score) = max(score)
    UNION ALL SELECT 1, min(score) - 1e-4 FROM {scores} UNION ALL SELECT 2, max(score) + 1e-4 FROM {scores}), {scores}
  GROUP BY kind, threshold) ORDER BY f1 DESC, kind, threshold LIMIT 1)"""


def _scores(spark: SparkSession, sf_dir: str, k: int = K) -> DataFrame:
    near = knn.mean_distances(tables.vectors(spark, sf_dir), ["image_id"], tables.bank(spark, sf_dir), "squared_euclidean", [k])
    scored = near.select("image_id", F.round("dist", 6).alias("score"))
    return scored.join(tables.maps(spark, sf_dir).select("image_id", "class"), "image_id")


def _long(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


# ---- scans, strings, scalars ------------------------------------------------------------------------------------------------------

_NAMES = ["a.jpg", "b.JPEG", "c.png", "d.txt", "e.Tiff", "f.webp", "g.bmp.zip", "h"]


@query(
    "SELECT image_id, path, lower(regexp_extract(path, '\\.([^./]*)$', 1)) AS ext FROM (SELECT vec_id AS image_id, 'img/' || vec_id || '/' || ([" + ", ".join(f"'{n}'" for n in _NAMES) + "])[(vec_id % 8 + 1)::INTEGER] AS path FROM embeddings) "
    "WHERE lower(regexp_extract(path, '\\.([^./]*)$', 1)) IN (" + ", ".join(f"'{e}'" for e in scalars.IMAGE_EXTENSIONS) + ")"
)
def scan_filter_ext(spark, sf_dir):
    name = F.element_at(F.array(*(F.lit(n) for n in _NAMES)), (F.col("vec_id") % 8 + 1).cast("int"))
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.concat(F.lit("img/"), F.col("vec_id").cast("string"), F.lit("/"), name).alias("path"))
    return rows.where(scalars.is_image(F.col("path"))).withColumn("ext", scalars.extension(F.col("path"))).orderBy(F.lower("path"))


@query(f"WITH {CELLS} SELECT image_id, (y * 4 + x)::BIGINT AS patch_idx, c::BIGINT AS c, y::BIGINT AS y, x::BIGINT AS x, v AS value FROM cells")
def patch_explode(spark, sf_dir):
    rows = features.cells(tables.maps(spark, sf_dir), "image_id", "data", 4, 4)
    return _long(rows.withColumn("patch_idx", F.col("y") * 4 + F.col("x")), "patch_idx", "c", "y", "x").select("image_id", "patch_idx", "c", "y", "x", "value")


@query(
    "SELECT event_id, least(greatest(value, 10.0), 400.0) AS clamped, round_even(value / 7, 0)::BIGINT AS rounded, floor(value)::BIGINT AS floored, abs(value - 250) AS off, sqrt(value) AS root, "
    "greatest(1, round_even(value * 0.1, 0)::BIGINT) AS coreset_size FROM events"
)
def scalar_functions(spark, sf_dir):
    v = F.col("value")
    return read(spark, sf_dir, "events").select(
        "event_id", scalars.clamp(v, 10.0, 400.0).alias("clamped"), scalars.half_even(v / 7).alias("rounded"), F.floor(v).cast("long").alias("floored"), F.abs(v - 250).alias("off"), F.sqrt(v).alias("root"),
        F.greatest(F.lit(1).cast("long"), scalars.half_even(v * 0.1)).alias("coreset_size"),
    )


@query(
    "SELECT event_id, CASE WHEN ms >= 3600000 THEN printf('%.1fh', ms / 3600000.0) WHEN ms >= 60000 THEN printf('%.1fm', ms / 60000.0) WHEN ms >= 1000 THEN printf('%.1fs', ms / 1000.0) ELSE printf('%.0fms', ms) END AS elapsed "
    "FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN value WHEN 1 THEN value * 100 WHEN 2 THEN value * 1000 ELSE value * 60000 END AS ms FROM events)"
)
def format_elapsed(spark, sf_dir):
    v, by = F.col("value"), F.col("event_id") % 4
    ms = F.when(by == 0, v).when(by == 1, v * 100).when(by == 2, v * 1000).otherwise(v * 60000)
    return read(spark, sf_dir, "events").select("event_id", scalars.elapsed(ms).alias("elapsed"))


@query(
    "SELECT user_id, event_type, round(ms, 6) AS ms, CASE WHEN total > 0 THEN printf('%.1f%%', round(ms, 6) / round(total, 6) * 100) ELSE '' END AS share FROM "
    "(SELECT user_id, event_type, sum(value) AS ms, sum(sum(value)) OVER (PARTITION BY user_id) AS total FROM events GROUP BY user_id, event_type)"
)
def stage_percentages(spark, sf_dir):
    rows = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.sum("value").alias("ms"))
    totals = rows.groupBy("user_id").agg(F.sum("ms").alias("total"))
    ms = F.round("ms", 6)
    return rows.join(totals, "user_id").select("user_id", "event_type", ms.alias("ms"), scalars.percentage(ms, F.round("total", 6)).alias("share"))


@query(
    "SELECT page_id, CASE WHEN trim(clean) = '' THEN 'default' ELSE clean END AS profile, regexp_replace(name, '(_fused_fp16_int8|_fused_int8|_fused_fp16|_fused|_int8|_fp16)$', '', 'i') AS base FROM "
    """(SELECT page_id, regexp_replace(trim(url), '[\\x00-\\x1f<>:"/\\\\|?*]', '', 'g') AS clean, 'net' || page_id || (['_FUSED_fp16_int8', '_fused_int8', '_fused', '', '_Int8', '_x'])[(page_id % 6 + 1)::INTEGER] AS name FROM pages)"""
)
def sanitise_strip(spark, sf_dir):
    end = F.element_at(F.array(*(F.lit(s) for s in ["_FUSED_fp16_int8", "_fused_int8", "_fused", "", "_Int8", "_x"])), (F.col("page_id") % 6 + 1).cast("int"))
    return read(spark, sf_dir, "pages").select("page_id", scalars.sanitised(F.col("url")).alias("profile"), scalars.without_variant(F.concat(F.lit("net"), F.col("page_id").cast("string"), end)).alias("base"))


@query("SELECT event_id, (json_extract(props, '$.k'))::BIGINT AS k, '{\"event\":' || event_id || ',\"type\":\"' || event_type || '\"}' AS encoded FROM events")
def props_json(spark, sf_dir):
    parsed = F.from_json("props", "k long")["k"]
    return read(spark, sf_dir, "events").select("event_id", parsed.alias("k"), F.to_json(F.struct(F.col("event_id").alias("event"), F.col("event_type").alias("type"))).alias("encoded"))


def _sql_variants(order: list[str]) -> str:
    return f"""WITH stems AS (SELECT 'net' || vec_id AS stem, vec_id FROM embeddings), files AS (SELECT stem || e AS file FROM stems, (VALUES ('_fused_fp16.onnx', 2), ('_fused.onnx', 3), ('.onnx', 5), ('_fused_int8.onnx', 7)) v(e, m) WHERE vec_id % m = 0),
wanted AS (SELECT stem, r, stem || e || '.onnx' AS file FROM stems, (VALUES {", ".join(f"({k}, '{e}')" for k, e in enumerate(order))}) v(r, e))
SELECT stem, coalesce(arg_min(w.file, CASE WHEN f.file IS NOT NULL THEN r END), stem || '.onnx') AS choice FROM wanted w LEFT JOIN files f ON w.file = f.file GROUP BY stem"""


def _variants(spark, sf_dir, prefer_gpu: bool) -> DataFrame:
    stems = read(spark, sf_dir, "embeddings").select(F.concat(F.lit("net"), F.col("vec_id").cast("string")).alias("stem"), "vec_id")
    there = F.array(*(F.when(F.col("vec_id") % m == 0, F.lit(e)) for e, m in (("_fused_fp16.onnx", 2), ("_fused.onnx", 3), (".onnx", 5), ("_fused_int8.onnx", 7))))
    files = stems.select("stem", F.explode(F.array_compact(there)).alias("e")).select(F.concat("stem", "e").alias("file"))
    return catalog.preferred_variants(stems, files, prefer_gpu=prefer_gpu)


@query(_sql_variants(catalog.GPU_ORDER))
def variant_coalesce_gpu(spark, sf_dir):
    return _variants(spark, sf_dir, True)


@query(_sql_variants(catalog.CPU_ORDER))
def variant_coalesce_cpu(spark, sf_dir):
    return _variants(spark, sf_dir, False)


_IDS = ["ResNet18", "custom", "none", " resnet101"]
_LOOKUP = ", ".join(f"('{b[0]}', '{b[1]}', '{b[2]}')" for b in catalog.BACKBONES)


@query(
    f"SELECT vec_id AS image_id, asked, coalesce(backbone_id, 'wide_resnet50_2') AS backbone_id, coalesce(name, 'WideResNet-50') AS name, coalesce(file, 'models/wide_resnet50_2_features.onnx') AS file FROM "
    f"(SELECT vec_id, ({_IDS})[(vec_id % 4 + 1)::INTEGER] AS asked FROM embeddings) LEFT JOIN (VALUES {_LOOKUP}) v(backbone_id, name, file) ON lower(trim(asked)) = backbone_id"
)
def catalog_lookup(spark, sf_dir):
    asked = F.element_at(F.array(*(F.lit(i) for i in _IDS)), (F.col("vec_id") % 4 + 1).cast("int"))
    return catalog.resolved(read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), asked.alias("asked")), "asked")


@query("SELECT vec_id AS image_id, least(greatest(24 | 1, 3), least(h, w) | 1)::BIGINT AS side FROM (SELECT vec_id, vec_id % 40 + 2 AS h, vec_id % 23 + 3 AS w FROM embeddings)")
def kernel_sizes(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), scalars.kernel_size(F.col("vec_id") % 40 + 2, F.col("vec_id") % 23 + 3).alias("side"))


# ---- feature maps -----------------------------------------------------------------------------------------------------------------


def _exploded(rows: DataFrame) -> DataFrame:
    out = rows.select("image_id", "patch_idx", F.posexplode("emb").alias("c", "value"))
    return _long(out, "patch_idx", "c").select("image_id", "patch_idx", "c", F.round("value", 6).alias("value"))


@query(f"WITH {PATCHES} SELECT image_id, (y * 4 + x)::BIGINT AS patch_idx, c::BIGINT AS c, round(v, 6) AS value FROM means")
def local_aggregate_p3(spark, sf_dir):
    return _exploded(features.patches(tables.maps(spark, sf_dir), shape=tables.SHAPE, patch_size=3))


@query(f"WITH {CELLS} SELECT image_id, ((y // 2) * 2 + x // 2)::BIGINT AS patch_idx, c::BIGINT AS c, round(avg(v), 6) AS value FROM cells GROUP BY image_id, c, y // 2, x // 2")
def downscale_f2(spark, sf_dir):
    return _exploded(features.patches(tables.maps(spark, sf_dir), shape=tables.SHAPE, downscale=2))


@query(f"SELECT a.vec_id AS image_id, round({D2.format(a='a.embedding', b='b.embedding')}, 6) AS d2 FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def pairwise_l2(spark, sf_dir):
    rows = tables.maps(spark, sf_dir).select("image_id", "data")
    after = rows.select((F.col("image_id") - 1).alias("image_id"), F.col("data").alias("other"))
    return rows.join(after, "image_id").select("image_id", F.round(squared_l2(F.col("data"), F.col("other")), 6).alias("d2"))


# ---- maps and images as columns ---------------------------------------------------------------------------------------------------

#: A weight for each of the fused channels and targets: fixed, plain numbers.
_PROJECTION = np.array([[((t * 7 + c) % 5 - 2) / 4 for c in range(7)] for t in range(3)])
_SIDE = 5  # of the kernel on a map of 4 x 4


def _sql_bilinear(name: str, n_out: int, n_in: int) -> str:
    """CTE (o, i, wt): the weight of source place i in place o of the result."""
    return f"""{name}_at AS (SELECT o::BIGINT AS o, floor((o + 0.5) * {n_in} / {n_out} - 0.5)::BIGINT AS low, (o + 0.5) * {n_in} / {n_out} - 0.5 AS src FROM range({n_out}) t(o)),
{name} AS (SELECT o, i, sum(wt)::DOUBLE AS wt FROM (SELECT o, least(greatest(low, 0), {n_in - 1}) AS i, CASE WHEN low < 0 THEN 1 ELSE 1 - (src - low) END AS wt FROM {name}_at
UNION ALL SELECT o, least(greatest(low + 1, 0), {n_in - 1}), CASE WHEN low < 0 THEN 0 ELSE src - low END FROM {name}_at) GROUP BY o, i)"""


_GAUSS = f"""taps AS (SELECT k, exp(-(k * k) / 32.0) / (SELECT sum(exp(-(j * j) / 32.0)) FROM range({-(_SIDE // 2)}, {_SIDE // 2 + 1}) u(j)) AS wt FROM range({-(_SIDE // 2)}, {_SIDE // 2 + 1}) t(k)),
mirror AS (SELECT o, CASE WHEN abs(o + k) > 3 THEN 6 - abs(o + k) ELSE abs(o + k) END AS i, wt FROM range(4) t(o), taps),
smooth AS (SELECT c.image_id, a.o AS y, b.o AS x, sum(a.wt * b.wt * c.v) AS v FROM cells c JOIN mirror a ON c.y = a.i JOIN mirror b ON c.x = b.i WHERE c.c = 0 GROUP BY c.image_id, a.o, b.o)"""
#: An image of 4 x 4 points from the first 48 values of a vector.
_IMAGE = "image AS (SELECT vec_id AS image_id, i // 3 AS p, i % 3 AS c, floor(abs(embedding[i + 1]::DOUBLE) * 97)::BIGINT % 256 AS v FROM embeddings, range(48) t(i))"


def _first_map(spark, sf_dir) -> DataFrame:
    """The first channel of each map, as a score map of 4 x 4."""
    return tables.maps(spark, sf_dir).select("image_id", F.slice("data", 1, 16).cast("array<double>").alias("scores"))


def _images(spark, sf_dir) -> DataFrame:
    point = lambda x: F.floor(F.abs(x.cast("double")) * 97) % 256
    return tables.maps(spark, sf_dir).select("image_id", F.transform(F.slice("data", 1, 48), point).cast("array<double>").alias("image"))


def _points(rows: DataFrame, values: str, digits: int = 6) -> DataFrame:
    return _long(rows.select("image_id", F.posexplode(values).alias("pos", "value")), "pos").select("image_id", "pos", F.round("value", digits).alias("value"))


@query(
    f"""WITH {CELLS}, {_sql_bilinear('up', 4, 2)}, far AS (SELECT vec_id AS image_id, i // 4 AS c, (i % 4) // 2 AS y, i % 2 AS x, embedding[48 + i + 1]::DOUBLE AS v FROM embeddings, range(16) t(i)),
every AS (SELECT image_id, c, y, x, v FROM cells WHERE c < 3 UNION ALL SELECT image_id, 3 + f.c, a.o, b.o, sum(a.wt * b.wt * f.v) FROM far f JOIN up a ON f.y = a.i JOIN up b ON f.x = b.i GROUP BY image_id, f.c, a.o, b.o)
SELECT image_id, (t * 16 + y * 4 + x)::BIGINT AS pos, round(sum(((t * 7 + c) % 5 - 2) / 4.0 * v), 6) AS value FROM every, range(3) u(t) GROUP BY image_id, t, y, x"""
)
def fused_layers(spark, sf_dir):
    """Two layers' maps, of 4 x 4 and 2 x 2 points, fused and projected to three channels."""
    rows = tables.maps(spark, sf_dir).select("image_id", F.slice("data", 1, 48).alias("near"), F.slice("data", 49, 16).alias("far"))
    return _points(features.fused(rows, "near", (3, 4, 4), "far", (4, 2, 2), _PROJECTION).select("image_id", "data"), "data")


@query(f"WITH {CELLS}, {_GAUSS} SELECT image_id, (y * 4 + x)::BIGINT AS pos, round(v, 6) AS value FROM smooth")
def map_smoothing(spark, sf_dir):
    return _points(_first_map(spark, sf_dir).select("image_id", maps.smoothed(F.col("scores"), (4, 4)).alias("smooth")), "smooth")


@query(
    f"WITH {CELLS}, {_sql_bilinear('up', 7, 4)}, {_sql_bilinear('across', 3, 4)} SELECT image_id, (a.o * 3 + b.o)::BIGINT AS pos, round(sum(a.wt * b.wt * v), 6) AS value "
    "FROM cells JOIN up a ON y = a.i JOIN across b ON x = b.i WHERE c = 0 GROUP BY image_id, a.o, b.o"
)
def map_resize(spark, sf_dir):
    return _points(_first_map(spark, sf_dir).select("image_id", maps.resized(F.col("scores"), (4, 4), (7, 3)).alias("full")), "full")


_RAMP = "round_even(greatest(least(1.5 - abs(4 * (level / 255.0) - {c}), 1), 0) * 255, 0)"


@query(
    f"""WITH {CELLS}, {_IMAGE}, ranged AS (SELECT image_id, y * 4 + x AS p, v, min(v) OVER w AS low, max(v) OVER w AS high FROM cells WHERE c = 0 WINDOW w AS (PARTITION BY image_id)),
leveled AS (SELECT image_id, p, CASE WHEN high - low > 1e-8 THEN round_even((v - low) * 255 / (high - low), 0) END AS level FROM ranged)
SELECT image_id, (p * 3 + c)::BIGINT AS pos, coalesce(round_even(0.6 * v + 0.4 * CASE c WHEN 0 THEN {_RAMP.format(c=1)} WHEN 1 THEN {_RAMP.format(c=2)} ELSE {_RAMP.format(c=3)} END, 0), v)::BIGINT AS value
FROM image JOIN leveled USING (image_id, p)"""
)
def heat_blend(spark, sf_dir):
    """Levels of a score map on the rainbow, blended over an image."""
    rows = _images(spark, sf_dir).join(_first_map(spark, sf_dir), "image_id")
    out = rows.select("image_id", maps.blended(F.col("image"), maps.colours(maps.levels(F.col("scores")))).alias("points"))
    return _long(out.select("image_id", F.posexplode("points").alias("pos", "value")), "pos", "value")


_MODES = {"fused": "px", "standard": "(px - mean) / 255 / std", "normalised": "(px / 255 - mean) / std"}


@query(
    f"""WITH {_IMAGE}, {_sql_bilinear('wide', 8, 4)}, full_ AS (SELECT image_id, a.o AS y, b.o AS x, c, round_even(sum(a.wt * b.wt * v), 0) AS px FROM image JOIN wide a ON p // 4 = a.i JOIN wide b ON p % 4 = b.i GROUP BY image_id, a.o, b.o, c),
stats AS (SELECT * FROM (VALUES (2, 0.485::DOUBLE, 0.229::DOUBLE), (1, 0.456, 0.224), (0, 0.406, 0.225)) s(c, mean, std)) """
    + " UNION ALL ".join(f"SELECT image_id, '{m}' AS mode, ((2 - c) * 64 + y * 8 + x)::BIGINT AS pos, round({e}, 6) AS value FROM full_ JOIN stats USING (c)" for m, e in _MODES.items())
)
def preprocess_modes(spark, sf_dir):
    """Images resized (to a power of two, whose weights and halves are exact), their channels in the other order and as planes, in all three modes."""
    rows = checkpointed(_images(spark, sf_dir))
    parts = [_points(rows.select("image_id", maps.preprocessed(F.col("image"), (4, 4), 8, m).alias("planes")), "planes").withColumn("mode", F.lit(m)) for m in _MODES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ---- neighbours -------------------------------------------------------------------------------------------------------------------

_EVERY = f"{BANK}, q AS (SELECT image_id, data AS emb FROM maps)"
#: More neighbours than the smallest banks have rows.
_MANY = 600


@query(f"WITH {_EVERY}, {sql_near('q')} SELECT image_id, rank::BIGINT AS rank, bank_id, round(sqrt(d2), 6) AS dist FROM near")
def knn_exact_k9(spark, sf_dir):
    near = knn.nearest(tables.vectors(spark, sf_dir), ["image_id"], tables.bank(spark, sf_dir), K)
    return _long(near, "rank").select("image_id", "rank", "bank_id", F.round(F.sqrt("d2"), 6).alias("dist"))


@query(f"WITH {_EVERY}, {sql_near('q')} SELECT image_id, rank::BIGINT AS rank, bank_id, round(sqrt(d2), 6) AS dist FROM near")
def knn_exact_blocked(spark, sf_dir):
    """The same join by the way of large banks: blocks of the bank come round, in two rounds at the least."""
    bank = tables.bank(spark, sf_dir)
    near = knn.nearest(tables.vectors(spark, sf_dir), ["image_id"], bank, K, limit=knn.bank_bytes(bank) // 7, round_bytes=knn.bank_bytes(bank) // 2)
    return _long(near, "rank").select("image_id", "rank", "bank_id", F.round(F.sqrt("d2"), 6).alias("dist"))


@query(f"WITH {_EVERY}, {sql_near('q')} SELECT image_id, round(avg(d2), 6) AS euclidean, round(avg(sqrt(d2)), 6) AS squared_euclidean FROM near GROUP BY image_id")
def knn_metrics(spark, sf_dir):
    near = checkpointed(knn.nearest(tables.vectors(spark, sf_dir), ["image_id"], tables.bank(spark, sf_dir), K))
    a, b = (knn.averaged(near, ["image_id"], m).select("image_id", F.round("dist", 6).alias(m)) for m in ("euclidean", "squared_euclidean"))
    return a.join(b, "image_id")


@query(f"WITH {_EVERY}, {sql_near('q', _MANY)} SELECT image_id, count(*) AS n, round(avg(sqrt(d2)), 6) AS dist FROM near GROUP BY image_id")
def knn_small_bank(spark, sf_dir):
    """More neighbours than a small bank has: all its rows count."""
    near = checkpointed(knn.nearest(tables.vectors(spark, sf_dir), ["image_id"], tables.bank(spark, sf_dir), _MANY))
    mean = knn.averaged(near, ["image_id"], "squared_euclidean")
    return near.groupBy("image_id").agg(F.count(F.lit(1)).alias("n")).join(mean, "image_id").select("image_id", "n", F.round("dist", 6).alias("dist"))


_PATCH_BANK = "b AS (SELECT e0, e1, e2, e3 FROM patches WHERE label < 8), q AS (SELECT * FROM patches)"


def _patch_scores(spark, sf_dir) -> DataFrame:
    """Patches of all maps against those of the normal ones."""
    every = features.patches(tables.maps(spark, sf_dir), shape=tables.SHAPE, patch_size=3)
    normal = features.patches(tables.maps(spark, sf_dir).where("class = 'OK'"), shape=tables.SHAPE, patch_size=3)
    return knn.mean_distances(every, ["image_id", "patch_idx"], normal.select((F.col("image_id") * 16 + F.col("patch_idx")).alias("bank_id"), "emb"), "squared_euclidean", [K])


@query(f"WITH {PATCHES}, {_PATCH_BANK}, {sql_patch_scores('q', 'b', 'ps')} SELECT image_id, round(max(dist), 6) AS score FROM ps GROUP BY image_id")
def image_score_max(spark, sf_dir):
    return knn.image_scores(_patch_scores(spark, sf_dir)).select("image_id", F.round("score", 6).alias("score"))


@query(f"WITH {PATCHES}, {_PATCH_BANK}, {sql_patch_scores('q', 'b', 'ps')} SELECT image_id, list(round(dist, 6) ORDER BY patch_idx) AS scores FROM ps GROUP BY image_id")
def score_maps(spark, sf_dir):
    rows = features.score_map(_patch_scores(spark, sf_dir), "image_id", 4, 4)
    return rows.select("image_id", F.transform("scores", lambda x: F.round(x, 6)).alias("scores"))


@query(f"WITH {PATCHES}, {_PATCH_BANK}, {sql_patch_scores('q', 'b', 'ps')} SELECT image_id, patch_idx::BIGINT AS patch_idx, round((dist - min(dist) OVER w) / (max(dist) OVER w - min(dist) OVER w), 6) AS level FROM ps WINDOW w AS (PARTITION BY image_id)")
def heat_normalise(spark, sf_dir):
    return _long(render.normalised(_patch_scores(spark, sf_dir)), "patch_idx").select("image_id", "patch_idx", F.round("level", 6).alias("level"))


# ---- index, coreset ---------------------------------------------------------------------------------------------------------------


def _sql_ivf(before: str = BANK, width: int = 64) -> str:
    """CTEs up to ``posts`` (bank_id, emb, cluster_id) and ``cents`` (cluster_id, e) after eight iterations. ``before`` has the CTE ``bank``."""
    out = f"{before}, c0 AS (SELECT row_number() OVER (ORDER BY md5('0:' || bank_id), bank_id) - 1 AS cluster_id, emb::DOUBLE[] AS e FROM bank QUALIFY row_number() OVER (ORDER BY md5('0:' || bank_id), bank_id) <= {CLUSTERS})"
    for i in range(ivf.ITERATIONS):
        out += f""", a{i} AS MATERIALIZED (SELECT bank_id, emb, cluster_id FROM (SELECT bank_id, emb, cluster_id, row_number() OVER (PARTITION BY bank_id ORDER BY {D2.format(a="emb", b="e")}, cluster_id) AS r FROM bank, c{i}) WHERE r = 1),
m{i} AS (SELECT cluster_id, list(x ORDER BY d) AS e FROM (SELECT cluster_id, d, round(avg(emb[d]::DOUBLE), {ivf.DECIMALS}) AS x FROM a{i}, range(1, {width + 1}) t(d) GROUP BY cluster_id, d) GROUP BY cluster_id),
c{i + 1} AS MATERIALIZED (SELECT cluster_id, coalesce(m{i}.e, c{i}.e) AS e FROM c{i} LEFT JOIN m{i} USING (cluster_id))"""
    return f"{out}, posts AS (SELECT * FROM a{ivf.ITERATIONS - 1}), cents AS (SELECT * FROM c{ivf.ITERATIONS})"


def _index(spark, sf_dir):
    rows, centroids = ivf.build(tables.bank(spark, sf_dir), CLUSTERS)
    return checkpointed(rows), centroids


@query(f"WITH {_sql_ivf()} SELECT bank_id, cluster_id::BIGINT AS cluster_id FROM posts")
def ivf_assign(spark, sf_dir):
    return _long(ivf.build(tables.bank(spark, sf_dir), CLUSTERS)[0].select("bank_id", "cluster_id"), "cluster_id")


@query(f"WITH {_sql_ivf()} SELECT cluster_id::BIGINT AS cluster_id, d::BIGINT - 1 AS dim, round(e[d], 6) AS value FROM cents, range(1, 65) t(d)")
def ivf_centroids(spark, sf_dir):
    _, centroids = ivf.build(tables.bank(spark, sf_dir), CLUSTERS)
    return spark.createDataFrame([(i, j, float(x)) for i, row in enumerate(centroids.tolist()) for j, x in enumerate(row)], "cluster_id long, dim long, value double").withColumn("value", F.round("value", 6))


def _sql_probed(queries: str, probes: int | str, k: int | str = K, tag: str = "") -> str:
    """CTE ``near`` + tag: neighbours among the probed clusters, from the whole bank where they are too few. Numbers may be scalar subqueries."""
    return f"""pr{tag} AS (SELECT * FROM (SELECT image_id, emb, cluster_id, row_number() OVER (PARTITION BY image_id ORDER BY {D2.format(a="emb", b="e")}, cluster_id) AS p FROM {queries}, cents) WHERE p <= {probes}),
pp{tag} AS (SELECT pr{tag}.image_id, posts.bank_id, {D2.format(a=f"pr{tag}.emb", b="posts.emb")} AS d2 FROM pr{tag} JOIN posts USING (cluster_id)),
few{tag} AS (SELECT image_id FROM {queries} WHERE image_id NOT IN (SELECT image_id FROM pp{tag} GROUP BY image_id HAVING count(*) >= {k})),
pa{tag} AS (SELECT * FROM pp{tag} WHERE image_id NOT IN (SELECT image_id FROM few{tag}) UNION ALL SELECT q.image_id, posts.bank_id, {D2.format(a="q.emb", b="posts.emb")} FROM {queries} q JOIN few{tag} USING (image_id), posts),
near{tag} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY d2, bank_id) AS rank FROM pa{tag}) WHERE rank <= {k})"""


@query(f"WITH {_sql_ivf()}, q AS (SELECT image_id, data AS emb FROM maps), {_sql_probed('q', PROBES)} SELECT image_id, rank::BIGINT AS rank, bank_id, round(sqrt(d2), 6) AS dist FROM near")
def ivf_knn_p4(spark, sf_dir):
    near = ivf.nearest_probed(tables.vectors(spark, sf_dir), ["image_id"], *_index(spark, sf_dir), K, PROBES)
    return _long(near, "rank").select("image_id", "rank", "bank_id", F.round(F.sqrt("d2"), 6).alias("dist"))


@query(f"WITH {_sql_ivf()}, q AS (SELECT image_id, data AS emb FROM maps), {_sql_probed('q', 1, 60)} SELECT image_id, rank::BIGINT AS rank, bank_id, round(sqrt(d2), 6) AS dist FROM near")
def ivf_knn_fallback(spark, sf_dir):
    """One probe and 60 neighbours, without broadcasting the bank: queries with too few candidates search the whole bank."""
    near = ivf.nearest_probed(tables.vectors(spark, sf_dir), ["image_id"], *_index(spark, sf_dir), 60, 1, limit=0)
    return _long(near, "rank").select("image_id", "rank", "bank_id", F.round(F.sqrt("d2"), 6).alias("dist"))


_CORESET = """f AS (SELECT id, e FROM src ORDER BY md5('0:' || id), id LIMIT 1), n AS (SELECT greatest(1, round_even(count(*) * {ratio}, 0))::BIGINT AS m FROM src),
r(pick, cid, id, e, md) AS (
  SELECT 0::BIGINT, f.id, src.id, src.e, {first} FROM src, f
  UNION ALL
  SELECT pick + 1, nid, id, e, least(md, {next}) FROM (SELECT pick, id, e, md, first_value(id) OVER (ORDER BY md DESC, id) AS nid, first_value(e) OVER (ORDER BY md DESC, id) AS ne FROM r), n WHERE pick + 1 < m)"""


def sql_coreset(source: str, ratio: float) -> str:
    return f"src AS ({source}), " + _CORESET.format(ratio=ratio, first=D2.format(a="src.e", b="f.e"), next=D2.format(a="e", b="ne"))


_CORESET_SQL = f"WITH RECURSIVE {MAPS}, {sql_coreset('''SELECT image_id AS id, data::DOUBLE[] AS e FROM maps WHERE class = 'OK' ''', 0.1)} SELECT DISTINCT pick, cid AS bank_id FROM r"


@query(_CORESET_SQL)
def coreset_greedy(spark, sf_dir):
    return _long(coreset.sample(tables.bank(spark, sf_dir), 0.1), "pick").select("pick", "bank_id")


@query(_CORESET_SQL)
def coreset_distributed(spark, sf_dir):
    """The way of banks that do not fit one task."""
    return _long(coreset.sample(tables.bank(spark, sf_dir), 0.1, limit=0), "pick").select("pick", "bank_id")


# ---- splits -----------------------------------------------------------------------------------------------------------------------


def _sql_split(ok: str, ng: str) -> str:
    ranked = "(SELECT image_id, class, row_number() OVER (ORDER BY md5('{s}:' || image_id), image_id) - 1 AS p, count(*) OVER () AS n FROM maps WHERE class = '{c}')"
    return f"WITH {MAPS} SELECT image_id, class, {ok} AS subset FROM {ranked.format(s=42, c='OK')} UNION ALL SELECT image_id, class, {ng} FROM {ranked.format(s=43, c='NG')}"


@query(_sql_split("CASE WHEN p < floor(n * 0.6) THEN 'train' WHEN p < floor(n * 0.6) + floor(n * 0.2) THEN 'tune' ELSE 'test' END", "CASE WHEN p < floor(n * 0.5) THEN 'tune' ELSE 'test' END"))
def split_ratio(spark, sf_dir):
    return split.split(tables.maps(spark, sf_dir).select("image_id", "class")).select("image_id", "class", "subset")


@query(_sql_split("CASE WHEN p < 100 THEN 'train' WHEN p < 130 THEN 'tune' ELSE 'test' END", "CASE WHEN p < 25 THEN 'tune' ELSE 'test' END"))
def split_count(spark, sf_dir):
    return split.split(tables.maps(spark, sf_dir).select("image_id", "class"), counts=(100, 30, 25)).select("image_id", "class", "subset")


# ---- thresholds and searches ------------------------------------------------------------------------------------------------------


@query(f"WITH {sql_scores()} SELECT score AS threshold FROM (SELECT score, row_number() OVER (ORDER BY score) AS r, count(*) OVER () AS n FROM scores WHERE class = 'OK') WHERE r = greatest(1, least(n, round_even(n * 0.95, 0)))")
def p95_threshold(spark, sf_dir):
    value = ordered.p95(checkpointed(_scores(spark, sf_dir).where("class = 'OK'")), "score")
    return spark.createDataFrame([(value,)], "threshold double")


@query(f"WITH {sql_scores()} SELECT threshold, tp, tn, fp, fn, {RATES} FROM (SELECT {MANUAL}::DOUBLE AS threshold, {COUNTS.replace('threshold', str(MANUAL))} FROM scores)")
def confusion_at_threshold(spark, sf_dir):
    return tuning.confusion(_scores(spark, sf_dir), MANUAL)


@query(f"WITH {sql_scores()} SELECT * FROM {sql_best('scores')}")
def best_threshold(spark, sf_dir):
    return tuning.best_threshold(_scores(spark, sf_dir))


_TEXT_SCORES = "scores AS (SELECT n_chars::DOUBLE AS score, CASE WHEN quality = 0 THEN 'NG' ELSE 'OK' END AS class FROM labels JOIN documents USING (doc_id))"


@query(f"WITH {_TEXT_SCORES} SELECT * FROM {sql_best('scores')}")
def best_threshold_ties(spark, sf_dir):
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return tuning.best_threshold(rows.select(F.col("n_chars").cast("double").alias("score"), F.when(F.col("quality") == 0, "NG").otherwise("OK").alias("class")))


_KS = "WITH " + f"{BANK}, q AS (SELECT image_id, class, data AS emb FROM maps), {sql_near('q', max(tuning.NEIGHBOR_CANDIDATES))}" + "".join(
    f", s{k} AS (SELECT image_id, class, round(avg(sqrt(d2)), 6) AS score FROM near JOIN q USING (image_id) WHERE rank <= {k} GROUP BY image_id, class)" for k in tuning.NEIGHBOR_CANDIDATES
)


@query(_KS + " " + " UNION ALL ".join(f"SELECT *, {k}::BIGINT AS num_neighbors FROM {sql_best(f's{k}')}" for k in tuning.NEIGHBOR_CANDIDATES))
def k_sweep(spark, sf_dir):
    distances = knn.mean_distances(tables.vectors(spark, sf_dir), ["image_id"], tables.bank(spark, sf_dir), "squared_euclidean", list(tuning.NEIGHBOR_CANDIDATES), "num_neighbors")
    scored = distances.withColumn("score", F.round("dist", 6)).join(tables.maps(spark, sf_dir).select("image_id", "class"), "image_id")
    return _long(tuning.best_threshold(scored, ["num_neighbors"]), "num_neighbors")


@query("SELECT DISTINCT p::BIGINT AS ann_probes FROM (SELECT unnest([1, 2, 4, 6, 8, 12, 16, 24, 32]) AS p UNION ALL SELECT 10) WHERE p BETWEEN 1 AND 10")
def probe_candidates(spark, sf_dir):
    presets = spark.createDataFrame([(p,) for p in tuning.PROBE_PRESETS], "ann_probes long")
    return presets.union(spark.createDataFrame([(10,)], "ann_probes long")).where(F.col("ann_probes").between(1, 10)).distinct().orderBy("ann_probes")


_PS = tuning.probe_candidates(CLUSTERS)


@query(
    f"WITH {_sql_ivf()}, q AS (SELECT image_id, class, data AS emb FROM maps)"
    + "".join(f", {_sql_probed('q', p, K, f'_{p}')}, s{p} AS (SELECT image_id, class, round(avg(sqrt(d2)), 6) AS score FROM near_{p} JOIN q USING (image_id) GROUP BY image_id, class)" for p in _PS)
    + " " + " UNION ALL ".join(f"SELECT *, {p}::BIGINT AS ann_probes FROM {sql_best(f's{p}')}" for p in _PS)
)
def probe_sweep(spark, sf_dir):
    distances = ivf.swept(tables.vectors(spark, sf_dir), ["image_id"], *_index(spark, sf_dir), K, _PS, "squared_euclidean", "ann_probes")
    scored = distances.withColumn("score", F.round("dist", 6)).join(tables.maps(spark, sf_dir).select("image_id", "class"), "image_id")
    return _long(tuning.best_threshold(scored, ["ann_probes"]), "ann_probes")


@query(f"WITH {sql_scores()} SELECT CASE WHEN score > {MANUAL} THEN 'NG' ELSE 'OK' END AS label, count(*) AS n FROM scores GROUP BY 1")
def label_counts(spark, sf_dir):
    return pipeline.label_counts(_scores(spark, sf_dir).withColumn("label", tuning.label(F.col("score"), MANUAL)))


@query(f"WITH {sql_scores()} SELECT image_id, score, coalesce(CASE WHEN image_id % 3 = 0 THEN 1.1 END, {MANUAL})::DOUBLE AS threshold, score > coalesce(CASE WHEN image_id % 3 = 0 THEN 1.1 END, {MANUAL}) AS is_anomaly FROM scores")
def manual_threshold(spark, sf_dir):
    threshold = F.coalesce(F.when(F.col("image_id") % 3 == 0, F.lit(1.1)), F.lit(MANUAL))
    return _scores(spark, sf_dir).select("image_id", "score", threshold.alias("threshold"), tuning.is_anomaly(F.col("score"), threshold).alias("is_anomaly"))


# ---- the whole flow ---------------------------------------------------------------------------------------------------------------

_RATIO = EngineConfig().coreset_ratio
_FLOW = f"""{PATCHES}, {sql_coreset("SELECT image_id * 16 + patch_idx AS id, [e0, e1, e2, e3] AS e FROM patches WHERE label < 8", _RATIO)},
picked AS (SELECT DISTINCT pick, cid FROM r), b AS (SELECT pick AS bank_id, e[1] AS e0, e[2] AS e1, e[3] AS e2, e[4] AS e3 FROM picked JOIN src ON id = cid),
{sql_patch_scores("patches", "b", "qs")},
self AS (SELECT image_id, max(dist) AS score FROM qs JOIN maps USING (image_id) WHERE class = 'OK' GROUP BY image_id),
thr AS (SELECT score AS t FROM (SELECT score, row_number() OVER (ORDER BY score) AS r, count(*) OVER () AS n FROM self) WHERE r = greatest(1, least(n, round_even(n * 0.95, 0))))"""


@query(f"WITH RECURSIVE {_FLOW} SELECT image_id, round(max(dist), 6) AS score, max(dist) > max(t) AS is_anomaly, CASE WHEN max(dist) > max(t) THEN 'NG' ELSE 'OK' END AS label FROM qs, thr GROUP BY image_id")
def predict_pipeline(spark, sf_dir):
    """A model of all normal maps, and the predictions for all maps."""
    rows = tables.maps(spark, sf_dir)
    model = pipeline.train(rows.where("class = 'OK'"), EngineConfig(coreset_ratio=_RATIO), tables.SHAPE)
    return pipeline.predict(rows, model, tables.SHAPE).withColumn("score", F.round("score", 6))


_TUNE_RATIO = _RATIO


def _sql_tuned() -> str:
    """The flow in SQL: the seeded split, the coreset of the training part, its index, both searches on the tuning part, and the test."""
    parts = _sql_split("CASE WHEN p < floor(n * 0.6) THEN 'train' WHEN p < floor(n * 0.6) + floor(n * 0.2) THEN 'tune' ELSE 'test' END", "CASE WHEN p < floor(n * 0.5) THEN 'tune' ELSE 'test' END").removeprefix(f"WITH {MAPS} ")
    source = "SELECT image_id * 16 + patch_idx AS id, [e0, e1, e2, e3] AS e FROM patches JOIN parts USING (image_id) WHERE subset = 'train'"
    before = f"{PATCHES}, parts AS ({parts}), {sql_coreset(source, _TUNE_RATIO)}, bank AS (SELECT DISTINCT pick AS bank_id, src.e AS emb FROM r JOIN src ON src.id = cid)"
    asked = lambda name, subset: f"{name} AS (SELECT image_id * 16 + patch_idx AS image_id, [e0, e1, e2, e3] AS emb FROM patches JOIN parts USING (image_id) WHERE subset = '{subset}')"
    scores = lambda name, near, k: f"{name} AS (SELECT image_id, class, max(dist) AS score FROM (SELECT image_id // 16 AS image_id, avg(sqrt(d2)) AS dist FROM {near} WHERE rank <= {k} GROUP BY {near}.image_id) JOIN parts USING (image_id) GROUP BY image_id, class)"
    out = f"WITH RECURSIVE {_sql_ivf(before, 4)}, {asked('q', 'tune')}, {_sql_probed('q', PROBES, max(tuning.NEIGHBOR_CANDIDATES))}"
    out += "".join(f", {scores(f's{k}', 'near', k)}" for k in tuning.NEIGHBOR_CANDIDATES)
    out += ", ks AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT {k}::BIGINT AS candidate, threshold, f1 FROM {sql_best(f's{k}')}" for k in tuning.NEIGHBOR_CANDIDATES) + "), k AS MATERIALIZED (SELECT candidate AS k FROM ks ORDER BY f1 DESC, candidate LIMIT 1)"
    out += "".join(f", {_sql_probed('q', p, '(SELECT k FROM k)', f'_{p}')}, {scores(f'p{p}', f'near_{p}', '(SELECT k FROM k)')}" for p in _PS)
    out += ", ps AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT {p}::BIGINT AS candidate, threshold, f1 FROM {sql_best(f'p{p}')}" for p in _PS) + ")"
    # fewer probes unless more of them are better by over the tolerance, one after the other
    out += f", best AS MATERIALIZED (SELECT list_reduce(list({{'p': candidate, 't': threshold, 'f': f1}} ORDER BY candidate), lambda b, x: CASE WHEN x.f > b.f + {tuning.TOLERANCE} THEN x ELSE b END) AS b FROM ps)"
    out += f", {asked('tq', 'test')}, {_sql_probed('tq', '(SELECT b.p FROM best)', '(SELECT k FROM k)', '_t')}, {scores('scores', 'near_t', '(SELECT k FROM k)')}"
    out += f", test AS (SELECT threshold, tp, tn, fp, fn, {RATES} FROM (SELECT b.t AS threshold, {COUNTS.replace('threshold', 'b.t')} FROM scores, best GROUP BY b.t))"
    return out + " SELECT 'neighbors' AS step, candidate, round(threshold, 6) AS threshold, round(f1, 6) AS f1 FROM ks UNION ALL SELECT 'probes', candidate, round(threshold, 6), round(f1, 6) FROM ps UNION ALL SELECT 'test', k, round(threshold, 6), round(f1, 6) FROM test, k"


@query(_sql_tuned())
def train_and_tune(spark, sf_dir):
    """Split, training, both searches with an index, and the test: one row per candidate and one for the test."""
    done = pipeline.train_and_tune(tables.maps(spark, sf_dir), EngineConfig(coreset_ratio=_TUNE_RATIO, use_ann=True, ann_clusters=CLUSTERS), tables.SHAPE)
    rows = [("neighbors", r["num_neighbors"], r["threshold"], r["f1"]) for r in done.neighbor_sweep] + [("probes", r["ann_probes"], r["threshold"], r["f1"]) for r in done.probe_sweep]
    rows.append(("test", done.model.num_neighbors, done.model.threshold, done.test["f1"]))
    return spark.createDataFrame([(s, c, round(t, 6), round(f, 6)) for s, c, t, f in rows], "step string, candidate long, threshold double, f1 double")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anomaly scores and labels of all images by exact neighbours."""
    return _scores(spark, sf_dir).withColumn("label", tuning.label(F.col("score"), MANUAL)).select("image_id", "class", "score", "label")
