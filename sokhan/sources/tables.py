"""Reading the star-schema and transcript tables of a directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """Parquet table ``name`` of ``directory``; columns and filters are pruned by Catalyst downstream."""
    return spark.read.parquet(f"{directory}/{name}.parquet")
