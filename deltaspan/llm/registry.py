"""The queries of this subpackage and the SQL that some of them can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, clusters, decontaminate, html_text, licenses, merkle, mixing, near_duplicates, pii, quality, site_quality, token_counts, toxicity
from .common import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.found(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_texts(table(spark, sf_dir, "pages"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counts(table(spark, sf_dir, "documents"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.assign(table(spark, sf_dir, "documents"))


def op6_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources are the hosts here, and the languages of a source its paths."""
    return site_quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("source"), F.concat_ws("/", "source", "lang"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.rates(docs, docs, "lang")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.clustered(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", size=64, k=16, rounds=3)


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.documents_checked(table(spark, sf_dir, "documents"))


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op8 SQL can say."""
    return quality.verdicts(table(spark, sf_dir, "documents")).select(*quality.BASE_COLUMNS)


def pii_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op9 SQL can say."""
    return pii.scan(table(spark, sf_dir, "documents")).select("doc_id", *[f"n_{k}" for k in pii.BASE], "base_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_decontamination, op2_license_scan, op3_html_extraction, op4_token_counts, op5_near_duplicates,
        op6_site_quality, op7_mixing, op8_quality_rules, op9_pii, op10_toxicity, op11_centroid_clusters, op12_bpe, op13_merkle_manifest, quality_base_counts, pii_base_spans,
    )}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": decontaminate.ORACLE, "op5_near_duplicates": near_duplicates.ORACLE,
        "op11_centroid_clusters": clusters.ORACLE, "op13_merkle_manifest": merkle.ORACLE, "quality_base_counts": quality.ORACLE_BASE, "pii_base_spans": pii.ORACLE_BASE,
    }
