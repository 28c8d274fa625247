"""Tables of the test data, and what the rest of the library has for tables that outlive a job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vistalake.sources.tables import discard, fresh_path, shared_dir, sized, written  # noqa: F401


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
