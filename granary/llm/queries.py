"""Queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    bpe, decontaminate, exact_dedup, fill_in_middle, jaccard_join, line_dedup, near_vectors, packing, quality, sharding, spelling,
    substring_dedup, toxicity,
)
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.op1_jaccard_join(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op2_packing(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.op3_substring_dedup(table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.op4_bpe(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op5_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op6_decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.op7_line_dedup(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.op8_sharding(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op9_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.op10_near_vectors(table(spark, sf_dir, "embeddings"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.op11_fill_in_middle(table(spark, sf_dir, "documents"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.op12_spelling(table(spark, sf_dir, "documents"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.op13_exact_dedup(table(spark, sf_dir, "documents"))


OPERATORS: tuple[Query, ...] = (
    op1_jaccard_join,
    op2_packing,
    op3_substring_dedup,
    op4_bpe,
    op5_toxicity,
    op6_decontaminate,
    op7_line_dedup,
    op8_sharding,
    op9_quality,
    op10_near_vectors,
    op11_fill_in_middle,
    op12_spelling,
    op13_exact_dedup,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_jaccard_join": jaccard_join.ORACLE,
        "op3_substring_dedup": substring_dedup.ORACLE,
        "op6_decontaminate": decontaminate.ORACLE,
        "op7_line_dedup": line_dedup.ORACLE,
        "op10_near_vectors": near_vectors.ORACLE,
        "op8_sharding": sharding.oracle(),
        "op11_fill_in_middle": fill_in_middle.ORACLE,
        "op12_spelling": spelling.oracle(),
        "op13_exact_dedup": exact_dedup.ORACLE,
    }
