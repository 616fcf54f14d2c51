"""The corpus pipeline: quality rules, near-duplicates, repeated passages, source mixing and packing, each on all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandmill.llm import bin_completion, bwt_dedup, entropy_mix, robust_outliers, simhash_ball
from strandmill.llm.common import Scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the robust outlier rule reject go."""
    return robust_outliers.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles at similarity 0.8 or more) stays."""
    return simhash_ball.near_dedup(docs, least=0.8)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words that occur elsewhere too go from the texts."""
    return bwt_dedup.strip_words(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks for."""
    return entropy_mix.resample(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their sequences."""
    return bin_completion.pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("source mix", source_mix),
    ("best-fit packing", packing),
]

#: SQL can't express iterative estimates, XXH64 or the packing search; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark)
    for _, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
