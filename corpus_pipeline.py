"""Corpus pipeline: documents in, token ids out. Each stage's rows are written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vistalake.llm.bpe import default_vocabulary, token_digests
from vistalake.llm.decontamination import decontaminate
from vistalake.llm.jaccard import one_of_each
from vistalake.llm.quality import keep_good
from vistalake.llm.secrets import redact_secrets
from vistalake.llm.shared import documents, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return keep_good(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the least doc_id."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays."""
    return redact_secrets(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document that is left."""
    return token_digests(docs, default_vocabulary())


STAGES = [("quality_rules", quality_rules), ("ngram_jaccard", ngram_jaccard), ("decontamination", decontamination), ("secret_scan", secret_scan), ("bpe", bpe)]

#: Jaccard components, alignment and byte-pair encoding are not expressible in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
