"""Parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``<sf_dir>/<name>.parquet``, by any path Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, least_files: int = 4) -> DataFrame:
    """Deal a table of very few files over all cores: one row group is read by one task otherwise."""
    if len(df.inputFiles()) >= least_files:
        return df
    return df.repartition(max(least_files, df.sparkSession.sparkContext.defaultParallelism))
