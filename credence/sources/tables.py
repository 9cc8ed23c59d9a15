"""Table sources: parquet folders, or a database over JDBC read in parallel key ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def parquet_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def jdbc_table(
    spark: SparkSession, url: str, table: str, key: str, low: int, high: int, partitions: int, **options: str
) -> DataFrame:
    """A database table split on a numeric key; filters and columns are pushed to the database."""
    reader = spark.read.format("jdbc").options(
        url=url, dbtable=table, partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(partitions)
    )
    return reader.options(**options).load()
