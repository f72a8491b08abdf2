"""Policy migration and upsert report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from opsframe.operators.ordering import chunk_rows
from opsframe.operators.policies import (
    POLICY_BATCH,
    plan_policy_upsert,
    rewrite_policy_urls,
    roles_to_groups,
    roles_to_groups_items,
)

MIGRATIONS = {
    "urls_all": lambda p: rewrite_policy_urls(p, mode="all"),
    "urls_matched": lambda p: rewrite_policy_urls(p, mode="matched"),
    "item_roles": roles_to_groups_items,
    "entry_roles": roles_to_groups,
}


def migrate_policies(policies: DataFrame, mode: str | Sequence[str]) -> DataFrame:
    """Apply one migration or several in turn; names are the keys of ``MIGRATIONS``."""
    for name in [mode] if isinstance(mode, str) else mode:
        if name not in MIGRATIONS:
            raise ValueError(f"unknown migration {name!r}, expected one of {sorted(MIGRATIONS)}")
        policies = MIGRATIONS[name](policies)
    return policies


def policy_upsert_report(
    incoming: DataFrame,
    existing: DataFrame,
    override: bool = False,
    batch: int = POLICY_BATCH,
    order: str = "ord",
    existing_order: str = "ord",
) -> DataFrame:
    """``chunk_id, succeeded, failed`` per upload batch of the planned upsert."""
    plan = plan_policy_upsert(
        incoming.select("service", "name", order), existing, override, order, existing_order
    )
    return (
        chunk_rows(plan, batch, [order])
        .groupBy("chunk_id")
        .agg(
            F.count_if(F.col("action") != "fail").alias("succeeded"),
            F.count_if(F.col("action") == "fail").alias("failed"),
        )
    )
