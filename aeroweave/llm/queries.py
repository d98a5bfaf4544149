"""The corpus operators as registered queries: (spark, sf_dir) -> DataFrame over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import covertree, licenses, linededup, minhash, mixing, packing, quality, sstable, style_tree, toxicity
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_sstable_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.token_table(table(spark, sf_dir, "documents"))


def op2_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style_tree.extract(table(spark, sf_dir, "pages"))


def op3_tree_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op5_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_concat_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pieces(table(spark, sf_dir, "documents"))


def op7_segment_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(table(spark, sf_dir, "documents"))


def op8_dual_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.top_products(table(spark, sf_dir, "embeddings"))


def op9_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op10_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    own = (
        op1_sstable_tokens,
        op2_site_style_tree,
        op3_tree_quality,
        op4_pivotal_mix,
        op5_noisy_channel_toxicity,
        op6_concat_and_cut,
        op7_segment_line_dedup,
        op8_dual_tree_topk,
        op9_license_rules,
        op10_minhash_join,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op8_dual_tree_topk": covertree.duckdb_sql(), "op9_license_rules": licenses.duckdb_sql()}
