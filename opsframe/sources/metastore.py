"""Metastore tables, from parquet exports or straight from the database."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Table names and the id column that JDBC reads are split on.
TABLES = {
    "DBS": "DB_ID",
    "TBLS": "TBL_ID",
    "SDS": "SD_ID",
    "COLUMNS_V2": "CD_ID",
    "PARTITIONS": "PART_ID",
    "PARTITION_KEYS": "TBL_ID",
}


def scan_metastore(
    spark: SparkSession,
    source: str | dict[str, str],
    num_partitions: int = 64,
    quote: str = '"',
) -> dict[str, DataFrame]:
    """The six tables by name: ``source`` is a folder of parquet tables or JDBC options.

    JDBC reads are split into ``num_partitions`` id ranges. ``quote`` is the identifier quote
    of the database.
    """
    if isinstance(source, str):
        return {name: spark.read.parquet(f"{source.rstrip('/')}/{name}") for name in TABLES}
    return {
        name: _jdbc_table(spark, source, name, key, num_partitions, quote)
        for name, key in TABLES.items()
    }


def _jdbc_table(
    spark: SparkSession, options: dict[str, str], name: str, key: str, n: int, quote: str
) -> DataFrame:
    def q(word: str) -> str:
        return f"{quote}{word}{quote}"

    bounds = (
        spark.read.format("jdbc")
        .options(**options)
        .option("query", f"SELECT min({q(key)}) AS lo, max({q(key)}) AS hi FROM {q(name)}")
        .load()
        .first()
    )
    reader = spark.read.format("jdbc").options(**options).option("dbtable", q(name))
    if bounds[0] is not None:
        reader = reader.options(
            partitionColumn=q(key), lowerBound=bounds[0], upperBound=bounds[1] + 1, numPartitions=n
        )
    return reader.load()
