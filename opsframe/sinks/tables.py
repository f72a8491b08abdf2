"""Tabular sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from opsframe.functions import iso_ts

MODES = ("overwrite", "append", "ignore", "error")


def _csv_text(field: T.StructField) -> Column:
    col = F.col(field.name)
    if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
        return iso_ts(col).alias(field.name)
    if isinstance(field.dataType, T.BooleanType):
        return F.initcap(col.cast("string")).alias(field.name)
    return col


def write_csv(
    df: DataFrame, path: str, columns: Sequence[str] | None = None, mode: str = "error"
) -> None:
    """Headered CSV parts: ISO times, ``True``/``False``, empty text for null, doubled quotes."""
    chosen = df.select(*(columns or df.columns))
    chosen.select(*[_csv_text(f) for f in chosen.schema.fields]).write.mode(mode).csv(
        path, header=True, escape='"', nullValue="", emptyValue=""
    )


def _checked(mode: str) -> str:
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}, expected one of {MODES}")
    return mode


def write_table(
    df: DataFrame, name: str, mode: str = "overwrite", path: str | None = None
) -> None:
    """Save as a catalog table, with its data below ``path`` when one is given."""
    writer = df.write.mode(_checked(mode))
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(name)


def write_jdbc(
    df: DataFrame,
    url: str,
    table: str,
    driver: str,
    user: str,
    mode: str = "overwrite",
    **options: str,
) -> None:
    """Save as a database table; ``numPartitions`` in the options bounds the connections."""
    df.write.format("jdbc").options(
        url=url, dbtable=table, driver=driver, user=user, **options
    ).mode(_checked(mode)).save()


def preview(df: DataFrame, n: int = 5) -> None:
    """Print the schema and the first ``n`` rows."""
    df.printSchema()
    df.show(n, truncate=False)
