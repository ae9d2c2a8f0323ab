"""The registered queries of this subpackage, and their SQL where SQL can express them.

The other operators are held against brute-force versions in ``tests/llm``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import alignment, bpe_trie, golden_record, license_scan, minhash, packing, pii, quality_classifier, quality_rules, simhash, token_counts, toxicity, url_reputation
from lodestone.llm._common import read


def op1_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_trie.round_trip(read(spark, sf_dir, "documents"))


def op2_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the tables label pages only by number: a page's outcome is the quality label of that number
    outcomes = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    return url_reputation.judge(read(spark, sf_dir, "pages"), outcomes)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = read(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality_rules.judge(read(spark, sf_dir, "documents"), good)


def op4_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op5_toxicity_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents"))


def op7_simhash_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op8_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.fingerprint_edits(read(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.agreement(read(spark, sf_dir, "documents"))


def op12_pii_semi_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return pii.digest(pii.find(docs, pii.learn(docs)))


def op13_golden_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golden_record.golden(read(spark, sf_dir, "clients"))


def minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rest of operator 9: bands of the signatures joined, and the Jaccard similarity of the shingles verified."""
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_bpe_trie, op2_url_reputation, op3_quality_rules, op4_harmonic_packing, op5_toxicity_lexicon, op6_license_scan, op7_simhash_covering, op8_quality_ftrl, op9_minhash, op10_token_counts, op11_token_alignment, op12_pii_semi_markov, op13_golden_record, minhash_near_duplicates)
}

ORACLES: dict[str, str] = {"op2_url_reputation": url_reputation.oracle(), "op3_quality_rules": quality_rules.oracle(), "op6_license_scan": license_scan.oracle(), "op13_golden_record": golden_record.oracle(), "minhash_near_duplicates": minhash.oracle()}
