"""Deletion plan for backup objects."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame

from opsframe.operators.objects import DELETE_BATCH, filter_expired_objects
from opsframe.operators.ordering import chunk_rows


def retention_plan(
    listing: DataFrame,
    now: str | datetime | Column,
    batch: int = DELETE_BATCH,
    **where,
) -> DataFrame:
    """``folder, chunk_id, key``: what to delete, in batches of one folder's keys by key order.

    Takes days, layout, cluster, node and base as the expiry filter does.
    """
    doomed = filter_expired_objects(listing, now, **where).where("deletable")
    return chunk_rows(doomed.select("folder", "key"), batch, ["key"], by=["folder"]).select(
        "folder", "chunk_id", "key"
    )
