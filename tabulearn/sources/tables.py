"""Reading column tables."""

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table in the splits that the session's file settings give it."""
    return spark.read.parquet(path)
