"""Queries over the test tables, one per operator, with SQL twins where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    centroids, exact_dedup, importance, mixing, packing, pii, quality_model, quality_rules, secret_scan, simhash, suffix_dedup,
    token_counts, toxicity,
)
from .common import documents
from .twins import SQL  # noqa: F401


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": lambda spark, sf_dir: pii.find_personal_data(documents(spark, sf_dir)),
    "op2_secret_scan": lambda spark, sf_dir: secret_scan.find_secrets(documents(spark, sf_dir)),
    "op3_token_counts": lambda spark, sf_dir: token_counts.count_tokens(documents(spark, sf_dir)),
    "op4_mixing": lambda spark, sf_dir: mixing.mix(documents(spark, sf_dir)),
    "op5_toxicity": lambda spark, sf_dir: toxicity.score_toxicity(documents(spark, sf_dir), labels(spark, sf_dir)),
    "op6_quality_rules": lambda spark, sf_dir: quality_rules.judge(documents(spark, sf_dir)),
    "op7_packing": lambda spark, sf_dir: packing.pack(documents(spark, sf_dir)),
    "op8_exact_dedup": lambda spark, sf_dir: exact_dedup.exact_groups(documents(spark, sf_dir)),
    "op9_quality_model": lambda spark, sf_dir: quality_model.score_quality(documents(spark, sf_dir), labels(spark, sf_dir)),
    "op10_simhash": lambda spark, sf_dir: simhash.near_groups(documents(spark, sf_dir)),
    "op11_centroids": lambda spark, sf_dir: centroids.cluster_digest(embeddings(spark, sf_dir)),
    "op12_importance": lambda spark, sf_dir: importance.importance(documents(spark, sf_dir), benchmark(spark, sf_dir)),
    "op13_suffix_dedup": lambda spark, sf_dir: suffix_dedup.repeats_digest(documents(spark, sf_dir)),
}
