"""The thin ``opN_`` queries over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontam, divergence, hmm_lm, impact_topk, langid, license_join, mixing, pii_disclosure, quality_crf, secret_ledger, simhash_cover, url_reputation, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(F.col(key).cast("string")) % modulus


def op1_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = quality_crf.score_quality(docs, labels, fold("doc_id", 5) != 0)
    held_out = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality_crf.THRESHOLD).cast("int").alias("predicted"), "good_share", "n_lines", "n_bad_lines")


def op2_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A page's outcome is the quality label of its number; bad if any says so.
    labels = table(spark, sf_dir, "labels").filter("quality is not null")
    outcomes = labels.groupBy(F.col("doc_id").alias("page_id")).agg(F.bool_or(F.col("quality") == 0).alias("bad"))
    return url_reputation.judge(table(spark, sf_dir, "pages"), outcomes)


def op3_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.flag_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_join.scan_licenses(table(spark, sf_dir, "documents"))


def op5_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_disclosure.find_pii(table(spark, sf_dir, "documents"))


def op6_impact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact_topk.exact_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_subword_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"), fold("doc_id", 4) == 2)


def op8_water_filling_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_cover.near_duplicate_groups(table(spark, sf_dir, "documents"))


def op10_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_lm.hmm_scores(table(spark, sf_dir, "documents"), fold("doc_id", 7) == 2)


def op11_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_ledger.scan_documents(table(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_crf,
        op2_url_reputation,
        op3_template_decontamination,
        op4_license_join,
        op5_pii_disclosure,
        op6_impact_topk,
        op7_subword_langid,
        op8_water_filling_mix,
        op9_simhash_near_dedup,
        op10_hmm_lm,
        op11_secret_ledger,
        op12_embedding_whitening,
        op13_source_divergence,
    )
}

ORACLE: dict[str, str] = {
    "op2_url_reputation": url_reputation.SQL,
    "op4_license_join": license_join.SQL,
    "op6_impact_topk": impact_topk.SQL,
    "op8_water_filling_mix": mixing.SQL,
    "op11_secret_ledger": secret_ledger.SQL,
    "op13_source_divergence": divergence.SQL,
}
