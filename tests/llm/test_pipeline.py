"""The pipeline against its stages' brute-force meaning."""

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import _vocab, quality_classifier, toxicity
from lodestone.llm._common import crc_of_id
from tests.llm.test_copies import classes, jaccard
from tests.llm.test_filters import brute_evidence

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if k < 3:
            assert after.columns == COLUMNS
            assert after.join(docs, "doc_id", "left_anti").count() == 0
            kept.append(after.count())
            assert kept[-1] < kept[-2]
            docs = after
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    left = docs.join(labels, "doc_id").collect()
    assert sum(r["quality"] for r in left) >= 0.97 * len(left)
    assert sum(r["toxic"] for r in left) <= 0.05 * len(left)
    assert docs.select("text").distinct().count() == docs.count()
    tokens = {r["doc_id"]: r["doc_tokens"] for r in after.select("doc_id", "doc_tokens").distinct().collect()}
    library = _vocab.vocabulary("word_bpe_49k.json").library
    assert tokens == {r["doc_id"]: len(library.encode(r["text"], add_special_tokens=False).ids) + 1 for r in docs.collect()}
    sums = {r["doc_id"]: r["n"] for r in after.groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()}
    assert sums == tokens


def test_registered():
    import __spark_entry__ as entry

    assert [n for n in entry.queries() if n.startswith("op") and n[2].isdigit()] == [f"op{k}_{n}" for k, n in enumerate(["bpe_trie", "url_reputation", "quality_rules", "harmonic_packing", "toxicity_lexicon", "license_scan", "simhash_covering", "quality_ftrl", "minhash", "token_counts", "token_alignment", "pii_semi_markov", "golden_record"], 1)]
    assert "pipeline" in entry.queries() and corpus_pipeline.ORACLE_SQL is None


def test_own_verdicts(spark):
    """Rows without an id, or with one id for several texts, are dropped or stay by their own text."""
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for stage in (corpus_pipeline.quality, corpus_pipeline.clean):
        stay = stage(spark, docs, sf_dir).select("doc_id")
        good, bad = docs.join(stay, "doc_id").limit(20), docs.join(stay, "doc_id", "left_anti").limit(20)
        for key in (None, 10**9):
            other = lambda df, key=key: df.withColumn("doc_id", F.lit(key).cast("long")).withColumn("source", F.lit("other")).select(COLUMNS)
            got = stage(spark, docs.union(other(good)).union(other(bad)), sf_dir).where("source = 'other'")
            assert sorted(r["text"] for r in got.collect()) == sorted(r["text"] for r in good.collect())


CLASHING = ["gone_id", "text_key", "text_key_", "least", "row", "own", "node", "root", "predicted", "score", "label", "labelled", "bands", "id", "kept"]


def awkward(spark, folder):
    """The smallest tables with columns of clashing names, and rows without ids, with repeated ids, without texts, and near copies."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    clean = [r for r in rows if 60 < len(r[1].split()) < 400][:12]
    more = [(None, r[1] + " one more", *r[2:]) for r in clean[:4]] + [(None, r[1] + " one more", *r[2:]) for r in clean[:2]]
    more += [(clean[5][0], r[1], *r[2:]) for r in clean[6:9]] + [(clean[5][0], " ".join(r[1].split()[::-1]), *r[2:]) for r in clean[6:9]] + [clean[5]]
    more += [(900 + i, None, "en", "s", 0) for i in range(2)] + [(902, "", "en", "s", 0), (None, None, None, None, None), (903, "tiny", "en", "s", 4)]
    wide = spark.createDataFrame([*rows, *more], docs.schema).withColumns({c: F.lit(f"their {c}") for c in CLASHING})
    wide.write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").withColumn("row", F.lit(1)).write.parquet(f"{folder}/labels.parquet")
    return wide


def brute_pipeline(spark, docs, labels):
    """The (id, text) pairs that the first three stages keep, row by row."""
    weights = quality_classifier.train(docs, labels.where(crc_of_id("doc_id") % 5 != 0))
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]

    def quality(text):
        slots, values, _ = quality_classifier.per_text(*quality_classifier.Featuriser()(pa.array([text or ""])))
        return 1 / (1 + np.exp(-(weights[slots] @ values + weights[-1])))

    rows = [r for r in rows if quality(r[1]) >= 0.3]
    held = spark.createDataFrame(rows, "doc_id long, text string")
    lexicon, curve = toxicity.learn(held, labels.where(crc_of_id("doc_id") % 4 != 2))

    def toxic(text):
        folded = toxicity.fold(text or "")
        return 1 / (1 + np.exp(-(np.array(toxicity.shape(brute_evidence(lexicon, folded), len(folded.split()))) @ np.array(curve))))

    rows = [r for r in rows if toxic(r[1]) < 0.3]
    texts = sorted({t or "" for _, t in rows})
    least = {t: min((i for i, x in rows if (x or "") == t and i is not None), default=None) for t in texts}
    root = classes(range(len(texts)), lambda a, b: bool(texts[a].split()) and jaccard(texts[a], texts[b], 5) >= 0.8)
    groups = defaultdict(list)
    for k, top in root.items():
        groups[top].append((least[texts[k]] is None, least[texts[k]], texts[k]))
    # where only texts without ids are in a group any one of them may stay
    return [(min(g, key=lambda x: x[:2] if not x[0] else (True, 0))[1:], [x[2] for x in g]) for g in groups.values()]


def test_run_against_plain_python(spark, tmp_path):
    docs = awkward(spark, tmp_path)
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet")
    want = brute_pipeline(spark, docs, labels)
    stage = docs
    for _, f in corpus_pipeline.STAGES[:3]:
        stage = f(spark, stage, str(tmp_path))
        assert stage.columns == docs.columns
    got = stage.collect()
    assert all(r[c] == f"their {c}" for r in got for c in CLASHING)
    assert sorted((str(r["doc_id"]) for r in got)) == sorted(str(w[0][0]) for w in want)
    for (i, text), own in want:
        assert sum(r["doc_id"] == i and (r["text"] or "") in ([text] if i is not None else own) for r in got) >= 1
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    library = _vocab.vocabulary("word_bpe_49k.json").library
    tokens = lambda text: [*library.encode(text or "", add_special_tokens=False).ids, 2]
    assert sum(p["length"] for p in pieces) == sum(len(tokens(r["text"])) for r in got)
    known = defaultdict(list)
    for r in got:
        known[r["doc_id"]].append(tokens(r["text"]))
    for p in pieces:
        assert any(len(ids) == p["doc_tokens"] and zlib.crc32(np.array(ids[p["start"] : p["start"] + p["length"]], "<u4").tobytes()) == p["ids_crc32"] for ids in known[p["doc_id"]])


def test_run_of_empty_tables(spark, tmp_path):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    docs.limit(0).write.parquet(f"{tmp_path}/a/documents.parquet")
    labels.write.parquet(f"{tmp_path}/a/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/a").count() == 0
    docs.limit(30).write.parquet(f"{tmp_path}/b/documents.parquet")
    labels.limit(0).write.parquet(f"{tmp_path}/b/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").select("doc_id").distinct().count() > 0
