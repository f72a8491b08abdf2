"""Parquet folders and catalog tables."""

from pyspark.sql import DataFrame, SparkSession


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def scan_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)
