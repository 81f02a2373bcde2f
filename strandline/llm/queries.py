"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import clustering, decontamination, language_model, line_dedup, mixing, near_dedup, packing, quality, rules, secrets, sharding, toxicity, whitening
from .common import table

_BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = rules.rule_ledger(table(spark, sf_dir, "documents"))
    measures = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    base = F.col("fail_bits").bitwiseAND(F.lit(rules.mask("base"))) != 0
    return ledger.select("doc_id", *measures, base.alias("base_failed"), rules.passes(F.col("fail_bits"), "v1").alias("kept"), F.col("fail_bits").cast("long").alias("fail_bits"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    of = lambda kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of([kind])).cast("long").alias(f"n_{kind}") for kind in secrets.BASE]
    return found.select("doc_id", *counts, F.sha2(secrets.listed(of(secrets.BASE)).cast("binary"), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.drop_boilerplate(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.md5(F.col("text").cast("binary")).alias("clean_md5"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.language_model_scores(table(spark, sf_dir, "documents"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.clustering_report(table(spark, sf_dir, "embeddings"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitening_report(table(spark, sf_dir, "embeddings"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.cut_documents(table(spark, sf_dir, "documents"))
    digests = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return packing.number_sequences(digests)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_quality_classifier, op2_decontamination, op3_sharding, op4_quality_rules, op5_secret_scan, op6_minhash_near_dedup, op7_toxicity, op8_line_dedup, op9_mixing, op10_lm_scoring, op11_centroid_clustering, op12_whitening, op13_packing)
    return {f.__name__: f for f in ops} | {"rule_ablations": rule_ablations}


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.ablations(rules.rule_ledger(table(spark, sf_dir, "documents")), "v1")


def _failed(name: str) -> str:
    return f"CASE WHEN {rules.RULES[name]} THEN {1 << list(rules.RULES).index(name)} ELSE 0 END"


def oracle_sql() -> dict[str, str]:
    bits = " + ".join(map(_failed, rules.RULES))
    marked = f"{rules.MEASURE_SQL}, b AS (SELECT *, CAST({bits} AS BIGINT) AS fail_bits FROM m)"
    v1 = rules.mask("v1")
    by_rule = " UNION ALL ".join(
        f"SELECT '{r}' AS rule, count(*) FILTER (WHERE fail_bits & {1 << list(rules.RULES).index(r)} <> 0) AS n_failed, "
        f"count(*) FILTER (WHERE fail_bits & {v1} = {1 << list(rules.RULES).index(r)}) AS n_alone, "
        f"count(*) FILTER (WHERE fail_bits & {v1} <> 0) AS n_rejected, count(*) AS n_docs FROM b"
        for r in rules.POLICIES["v1"]
    )
    return {
        "op2_decontamination": decontamination.CONTAINMENT_SQL,
        "op4_quality_rules": f"{marked} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {_BASE_FAILED} AS base_failed, fail_bits & {v1} = 0 AS kept, fail_bits FROM b",
        "rule_ablations": f"{marked} {by_rule}",
        "op6_minhash_near_dedup": near_dedup.shingle_links_sql(3, 85),
        "op8_line_dedup": line_dedup.LINES_SQL,
        "op9_mixing": mixing.MIX_SQL,
        "op11_centroid_clustering": clustering.clustering_sql(),
    }
