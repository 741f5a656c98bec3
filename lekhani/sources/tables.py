"""The Parquet tables of one data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """Scan ``directory/name.parquet``; filters and column selection reach the scan."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def spread(df: DataFrame, least: int | None = None) -> DataFrame:
    """Rows over at least ``least`` partitions (default: the session's parallelism).

    Small files come as one partition; per-row work that costs much CPU needs more. A table that
    the scan already cut into enough partitions isn't shuffled.
    """
    wanted = least or df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)
