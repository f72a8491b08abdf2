"""Row retention: which rows are past it, and how many."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from opsframe.functions import epoch_ms_cutoff
from opsframe.functions.times import months_before
from opsframe.session import as_instant

RETENTION_MONTHS = 1


def expired(
    ts_col: str, now: str | datetime, months: int = RETENTION_MONTHS, unit: str = "timestamp"
) -> Column:
    """True for values past retention.

    Epoch milliseconds (``unit='ms'``) expire at the cutoff, timestamps strictly before it.
    The cutoff is a literal, so that the scan can skip by it.
    """
    if unit == "ms":
        return F.col(ts_col) <= epoch_ms_cutoff(now, months)
    if unit != "timestamp":
        raise ValueError(f"unknown unit {unit!r}, expected 'ms' or 'timestamp'")
    return F.col(ts_col) < as_instant(months_before(now, months))


def split_by_retention(
    df: DataFrame,
    ts_col: str,
    now: str | datetime,
    months: int = RETENTION_MONTHS,
    unit: str = "timestamp",
) -> tuple[DataFrame, DataFrame]:
    """The rows to delete and the rows to keep; rows without a time are kept."""
    past = expired(ts_col, now, months, unit)
    return df.where(past), df.where(~F.coalesce(past, F.lit(False)))


def retention_delete_counts(
    sources: Mapping[str, tuple[DataFrame, str, str]],
    now: str | datetime,
    months: int = RETENTION_MONTHS,
) -> DataFrame:
    """``source, deleted`` per source; ``sources`` maps names to ``(df, ts_col, unit)``."""
    result = None
    for name, (df, ts_col, unit) in sources.items():
        row = (
            df.where(expired(ts_col, now, months, unit))
            .agg(F.count(F.lit(1)).alias("deleted"))
            .select(F.lit(name).alias("source"), "deleted")
        )
        result = row if result is None else result.unionByName(row)
    if result is None:
        raise ValueError("no sources given")
    return result
