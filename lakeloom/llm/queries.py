"""Queries of the training-data operators over the tables in a folder, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_dedup

    return substring_dedup(_table(spark, sf_dir, "documents")).drop("kept_text")


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash_dedup import simhash_dedup

    return simhash_dedup(_table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_pii

    return find_pii(_table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import suffix_dedup

    return suffix_dedup(_table(spark, sf_dir, "documents")).drop("kept")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import quality

    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import language

    return language(_table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import decontaminate

    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(_table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .sentencepiece_codec import digests

    return digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extraction import extract

    return extract(_table(spark, sf_dir, "pages"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .centroid_clustering import cluster

    return cluster(_table(spark, sf_dir, "embeddings")).drop("scans")


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan

    return scan(_table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle_manifest import manifest

    return manifest(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_simhash_dedup": op2_simhash_dedup,
        "op3_pii": op3_pii,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_quality": op5_quality,
        "op6_language_id": op6_language_id,
        "op7_decontamination": op7_decontamination,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_sentencepiece": op9_sentencepiece,
        "op10_html_extraction": op10_html_extraction,
        "op11_centroid_clustering": op11_centroid_clustering,
        "op12_license_scan": op12_license_scan,
        "op13_merkle_manifest": op13_merkle_manifest,
    }


def oracle_sql() -> dict[str, str]:
    from . import license_scan as scan

    templates = [(label, base, scan.template_words(text)) for label, base, text in scan.TEMPLATES]
    return {
        "op1_substring_dedup": oracles.SUBSTRING,
        "op7_decontamination": oracles.DECONTAMINATION,
        "op8_exact_dedup": oracles.EXACT,
        "op10_html_extraction": oracles.HTML,
        "op11_centroid_clustering": oracles.clustering_sql(64, 16, 3),
        "op12_license_scan": oracles.license_sql(templates, scan.K, scan.DRIFT, scan.COVER),
        "op13_merkle_manifest": oracles.MERKLE,
    }
