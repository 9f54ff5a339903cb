"""Reading the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomwork.session import ship_package


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of the data folder; columns and filters reach the scan."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
