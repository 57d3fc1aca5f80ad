"""Access to the parquet tables that the registered queries read."""

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan of one table; column pruning and filters reach the parquet reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
