"""Workload and queue reports over query records."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame

from opsframe.operators import workload as w
from opsframe.session import staged


def workload_report(
    raw: DataFrame,
    now: str | datetime | Column,
    hours: int = w.LOOKBACK_HOURS,
    min_s: float = w.MIN_DURATION_S,
    k: int = 5,
    wording: str = "short",
    stage: bool = True,
) -> dict[str, DataFrame]:
    """Total, bottlenecks, slowest queries, heaviest users and queue alert.

    ``stage`` writes the flat records of the window once for all five parts.
    """
    recent = w.filter_lookback(raw, "startTime", now, hours)
    flat = w.filter_min_duration(w.flatten_query_records(recent), min_s)
    if stage:
        flat = staged(flat, "workload")
    return {
        "total": w.workload_total(flat),
        "bottlenecks": w.bottleneck_overview(flat, wording),
        "slowest": w.top_slow_queries(flat, k),
        "users": w.workload_by_user(flat, k),
        "congestion": w.queue_congestion(flat),
    }


def queue_report(
    raw: DataFrame,
    now: str | datetime | Column,
    hours: int = w.LOOKBACK_HOURS,
    stage: bool = True,
) -> dict[str, DataFrame]:
    """Load per coordinator and pressure per pool, over queued or slow queries."""
    recent = w.filter_lookback(raw, "startTime", now, hours)
    flat = w.filter_queue_or_slow(w.flatten_query_records(recent))
    if stage:
        flat = staged(flat, "queue")
    return {
        "coordinators": w.queue_by_coordinator(flat),
        "pools": w.queue_by_pool(flat),
    }
