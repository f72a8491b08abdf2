"""Number, flag and default functions."""

from typing import Any

from pyspark.sql import Column, functions as F

SECRET_MASK = "***"


def number(col: Column) -> Column:
    """Parse text as a number; missing or unreadable text counts as 0."""
    return F.coalesce(col.try_cast("double"), F.lit(0.0))


def flag(col: Column) -> Column:
    """A boolean from ``true``/``"TRUE"``; anything else, null too, is false."""
    return F.coalesce(F.lower(col.cast("string")) == "true", F.lit(False))


def ms_to_s(col: Column) -> Column:
    return col / F.lit(1000.0)


def pct(n: Column, total: Column) -> Column:
    """``n`` as a percentage of ``total``; 0 when there is nothing to divide by."""
    return F.when(total > 0, n * F.lit(100.0) / total).otherwise(F.lit(0.0))


def default_to(col: Column, value: Any) -> Column:
    return F.coalesce(col, F.lit(value))


def expected_pages(total: Column, page_size: int) -> Column:
    return F.ceil(total / F.lit(page_size)).cast("long")


def mask_secret() -> Column:
    """Stands for every new secret in an output; the secret itself never gets there."""
    return F.lit(SECRET_MASK)
