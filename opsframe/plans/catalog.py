"""Inventory report and table copies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from opsframe.operators.catalog import Metastore, table_inventory
from opsframe.sinks import preview, write_jdbc, write_table
from opsframe.sources import scan_table


def inventory_report(ms: Metastore, dbs: Sequence[str] | None = None) -> DataFrame:
    """Every table with its column and partition counts, by database and table."""
    return table_inventory(ms, dbs)


def copy_table(
    spark: SparkSession,
    source: str,
    target: str,
    mode: str = "overwrite",
    path: str | None = None,
    jdbc: dict[str, str] | None = None,
    show: bool = False,
) -> None:
    """Copy a catalog table into another one, or into a database table for ``jdbc`` options."""
    df = scan_table(spark, source)
    if show:
        preview(df)
    if jdbc is not None:
        write_jdbc(df, table=target, mode=mode, **jdbc)
    else:
        write_table(df, target, mode, path)
