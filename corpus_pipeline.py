"""The corpus pipeline: five stages, each writes documents that the next reads."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tempora.llm.op3_bpe import round_trip
from tempora.llm.op4_quality_resampling import resample
from tempora.llm.op5_mixing import mixed
from tempora.llm.op8_line_dedup import dedup_lines
from tempora.llm.op10_ngram_join import keep_one
from tempora.llm.workdir import checkpoint_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling selects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return resample(docs.select(*COLUMNS), labels).where("selected").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that are near copies of an earlier line; documents of only such lines go."""
    return dedup_lines(docs.select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingle sets with a Jaccard similarity of 0.75 or more."""
    return keep_one(docs.select(*COLUMNS))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source passed once at least, small ones up to 1.5 times, by temperature; rows in the order of the mix."""
    return mixed(docs.select(*COLUMNS))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and hashes of ids and of the decoded bytes, one row for each row of the mix."""
    return round_trip(docs)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("mixing sources to target weights", mixing), ("byte-level BPE encoding and decoding", encoding)]

#: No stage but the last could be told in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
