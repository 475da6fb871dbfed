"""Reading feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a folder; later selects and filters reach its scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stream_of(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The same table as a file stream; the schema comes from the files present now."""
    schema = table(spark, folder, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)
