"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.llm import decontamination, language_id, line_dedup, mixing, ngram_join
from trailweave.llm._columns import shielded
from trailweave.llm._store import stored


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID (10): drops documents without letters and those that resemble no language."""
    profiles = language_id.train_profiles(docs.where(language_id.fold("doc_id", 4) != 2))
    return language_id.recognised(docs, profiles)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup (9): takes later matching lines out of the texts; every document stays."""
    kind = docs.schema["n_chars"].dataType
    return shielded(docs, lambda given: line_dedup.dedup_lines(given).withColumn("n_chars", F.length("text").cast(kind)))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join (6): one document of each group of near-duplicates stays."""
    return ngram_join.one_of_each(docs)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination (1): drops contaminated documents."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights (7): samples documents by calibrated probabilities."""
    return mixing.sample(docs)


STAGES = [
    ("language ID", languages),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmarks),
    ("mixing sources to target weights", mixture),
]

#: Line dedup, the similarity join and raking have no SQL that ends in reasonable time; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
