"""Change plan for secret settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from opsframe.operators.configs import config_updates


def config_change_plan(items: DataFrame, wide: bool = True, dry_run: bool = True) -> DataFrame:
    """Secret settings to change by scope, with the action; the new value is always masked."""
    action = "would_update" if dry_run else "update"
    return config_updates(items, wide).withColumn("action", F.lit(action))
