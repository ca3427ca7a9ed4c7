"""A training corpus from `documents`: quality, near-duplicates, benchmark quotes, mix, token files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eventlake.llm.decontam import without_leaks
from eventlake.llm.mixing import mix
from eventlake.llm.neardup import without_near_duplicates
from eventlake.llm.quality import keep_good
from eventlake.llm.queries import table, tokenizer_path
from eventlake.llm.tokens import token_files
from eventlake.session import scratch_dir

ORACLE_SQL = None  # the stages learn a classifier and apply a tokenizer; tests hold them against brute force


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_near_duplicates(docs, percent=80)  # 85 is the contract of op10 alone


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_files(docs, tokenizer_path())


STAGES = [
    ("quality classifier", good),
    ("near-duplicates", distinct),
    ("benchmark decontamination", clean),
    ("mixing sources", mixed),
    ("token files", tokenised),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other; each is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_dir(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
