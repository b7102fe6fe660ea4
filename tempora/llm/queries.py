"""The queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracle
from .op10_ngram_join import ngram_components
from .op1_toxicity import toxicity
from .op2_quality_rules import quality_rules
from .op3_bpe import round_trip
from .op4_quality_resampling import quality_sample
from .op5_mixing import mixing_report
from .op6_suffix_dedup import repeats_digest
from .op7_fingerprints import fingerprints
from .op8_line_dedup import line_digest
from .op9_sharding import shard_digest


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_read(spark, sf_dir, "documents"))


def op4_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_sample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_report(_read(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats_digest(_read(spark, sf_dir, "documents"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(_read(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_digest(_read(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_digest(_read(spark, sf_dir, "documents"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        op1_toxicity,
        op2_quality_rules,
        op3_bpe,
        op4_quality_resampling,
        op5_mixing,
        op6_suffix_dedup,
        op7_fingerprints,
        op8_line_dedup,
        op9_sharding,
        op10_ngram_join,
    )
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op6_suffix_dedup": oracle.REPEATS, "op10_ngram_join": oracle.NGRAM_COMPONENTS}
