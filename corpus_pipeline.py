"""A training corpus from raw documents: each stage works on all rows that its predecessor kept, and its decisions take effect.

All stages but the last return the columns of documents. A stage gets the rows that the one before it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gaugeworks.llm import decontaminate, language_id, mixing, ngram_join, token_files
from gaugeworks.llm.shared import written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a language (no text, or no letter in it) go; the model is fitted on docs."""
    return language_id.accepted(docs, language_id.fit(docs))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group of near duplicates the document with the smallest doc_id stays."""
    return ngram_join.one_of_each_group(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a window of a benchmark item go."""
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources: each document as many times as the mix takes it."""
    return mixing.mixed(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files: doc_id, start, n_tokens and crc32 of the ids, as read back from the files."""
    return token_files.token_digests(docs)


STAGES = [("language ID", known_language), ("n-gram Jaccard join", one_of_each), ("benchmark decontamination", no_benchmark), ("mixing sources", source_mix), ("token files", token_output)]
#: Learned languages and tokenizing have no SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
