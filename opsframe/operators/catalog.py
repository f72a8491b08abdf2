"""Metastore inventory and the partition-key audit.

``ms`` maps table names (DBS, TBLS, SDS, COLUMNS_V2, PARTITIONS, PARTITION_KEYS) to DataFrames.
Columns and partitions are by far the largest tables: both are counted per key before they
meet anything, which leaves one row per key to join, however many rows a key has.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from opsframe.functions import split_part
from opsframe.operators.ordering import salted_join

Metastore = Mapping[str, DataFrame]


def filter_databases(ms: Metastore, dbs: Sequence[str] | None = None) -> DataFrame:
    """DBS, optionally only the named databases."""
    return ms["DBS"] if dbs is None else ms["DBS"].where(F.col("NAME").isin(*dbs))


def _tables(ms: Metastore, dbs: Sequence[str] | None) -> DataFrame:
    """``TBL_ID, SD_ID, TBL_NAME, DB_NAME`` of the tables that have a database.

    One database may hold most tables, so its rows are cut into pieces.
    """
    names = filter_databases(ms, dbs).select("DB_ID", F.col("NAME").alias("DB_NAME"))
    tables = ms["TBLS"].select("TBL_ID", "DB_ID", "SD_ID", "TBL_NAME")
    return salted_join(tables, names, ["DB_ID"], spread_by="TBL_ID").drop("DB_ID")


def _descriptor_columns(ms: Metastore) -> DataFrame:
    """``SD_ID, colCount`` of storage descriptors that have columns."""
    per_list = ms["COLUMNS_V2"].groupBy("CD_ID").agg(F.count(F.lit(1)).alias("colCount"))
    return ms["SDS"].select("SD_ID", "CD_ID").join(per_list, "CD_ID").drop("CD_ID")


def _table_partitions(ms: Metastore) -> DataFrame:
    return ms["PARTITIONS"].groupBy("TBL_ID").agg(F.count("PART_ID").alias("partCount"))


def column_counts(ms: Metastore, dbs: Sequence[str] | None = None) -> DataFrame:
    """``TBL_ID, colCount`` of tables that have columns and a database."""
    tables = _tables(ms, dbs).select("TBL_ID", "SD_ID")
    return tables.join(_descriptor_columns(ms), "SD_ID").select("TBL_ID", "colCount")


def partition_counts(ms: Metastore, dbs: Sequence[str] | None = None) -> DataFrame:
    """``TBL_ID, partCount`` of every table, 0 where it has no partition."""
    tables = ms["TBLS"] if dbs is None else _tables(ms, dbs)
    return (
        tables.select("TBL_ID")
        .join(_table_partitions(ms), "TBL_ID", "left")
        .select("TBL_ID", F.coalesce("partCount", F.lit(0)).alias("partCount"))
    )


def table_inventory(
    ms: Metastore, dbs: Sequence[str] | None = None, ordered: bool = True
) -> DataFrame:
    """``DB_NAME, TBL_NAME, colCount, partCount`` of every table, by database and table.

    ``colCount`` is null where a table has no columns. Each count joins the tables once.
    """
    rows = (
        _tables(ms, dbs)
        .join(_descriptor_columns(ms), "SD_ID", "left")
        .join(_table_partitions(ms), "TBL_ID", "left")
        .select(
            "DB_NAME", "TBL_NAME", "colCount", F.coalesce("partCount", F.lit(0)).alias("partCount")
        )
    )
    return rows.orderBy("DB_NAME", "TBL_NAME") if ordered else rows


def partition_key_mismatch(ms: Metastore, dbs: Sequence[str] | None = None) -> DataFrame:
    """Partitions whose first key differs from a declared key of the table.

    One row per partition and differing key, as only the first key of the name is looked at;
    tables without declared keys give none.
    """
    # The small tables meet first, so that partitions are shuffled once.
    declared = _tables(ms, dbs).join(ms["PARTITION_KEYS"].select("TBL_ID", "PKEY_NAME"), "TBL_ID")
    named = ms["PARTITIONS"].select(
        "TBL_ID", "PART_ID", split_part(F.col("PART_NAME"), "=", 1).alias("part_key")
    )
    return (
        salted_join(named, declared, ["TBL_ID"], spread_by="PART_ID")
        .where(F.col("part_key") != F.col("PKEY_NAME"))
        .select("TBL_ID", "DB_NAME", "TBL_NAME", "part_key", "PKEY_NAME")
    )
