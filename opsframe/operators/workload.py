"""Query-workload reports: bottlenecks, slow queries, heavy users, queues."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from opsframe.functions import default_to, flag, ms_to_s, number, pct
from opsframe.operators.ordering import top_k
from opsframe.session import as_instant

# Thresholds, look-back, and the texts of the bottleneck report.
LOOKBACK_HOURS = 24
MIN_DURATION_S = 5.0
QUEUE_FILTER_WAIT_MS = 100
QUEUE_FILTER_DURATION_S = 1.0
QUEUED_MS = 1000
QUEUE_ALERT_S = 5
BOTTLENECKS = {
    "short": [
        ("spilled", "Spilling to Disk", "Increase Mem / Fix Joins"),
        ("stats_missing", "Missing Table Stats", "Run COMPUTE STATS"),
        ("queued", "Admission Queueing", "Check Resource Pools"),
    ],
    "long": [
        ("spilled", "Spilling to Disk (CRITICAL)", "Increase MEM_LIMIT or optimize Join"),
        ("stats_missing", "Missing Table Stats (MAJOR)", "Run COMPUTE STATS"),
        ("queued", "Admission Queueing (>1s)", "Cluster is busy or Pool limits too low"),
    ],
}


def _first_text(*cols: Column) -> Column:
    """The first text that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def flatten_query_records(raw: DataFrame) -> DataFrame:
    """One flat row per record; missing numbers are 0, flags false, names their defaults."""

    def attribute(name: str) -> Column:
        return F.col("attributes")[name]

    duration_ms = number(attribute("query_duration"))
    wait_ms = number(attribute("admission_wait"))
    coordinator = F.col("coordinator")
    return raw.select(
        default_to(F.col("queryId"), "N/A").alias("query_id"),
        default_to(F.col("user"), "unknown").alias("user"),
        F.col("queryState").alias("state"),
        F.col("startTime").alias("query_time"),
        duration_ms.alias("duration_ms"),
        ms_to_s(duration_ms).alias("duration_s"),
        number(attribute("memory_per_node_peak")).alias("memory_per_node_peak"),
        flag(attribute("spilled")).alias("spilled"),
        flag(attribute("stats_missing")).alias("stats_missing"),
        wait_ms.alias("admission_wait_ms"),
        ms_to_s(wait_ms).alias("admission_wait_s"),
        (wait_ms > QUEUED_MS).alias("queued"),
        number(attribute("rows_inserted")).try_cast("bigint").alias("rows_inserted"),
        ms_to_s(number(attribute("planning_wait_time"))).alias("planning_wait_s"),
        ms_to_s(number(attribute("thread_network_receive_wait_time"))).alias(
            "network_receive_wait_s"
        ),
        default_to(
            _first_text(coordinator["hostname"], coordinator["hostId"]), "Unknown"
        ).alias("coordinator"),
        default_to(
            _first_text(attribute("request_pool"), attribute("pool")), "default"
        ).alias("pool"),
    )


def filter_lookback(
    df: DataFrame, ts_col: str, now: str | datetime | Column, hours: int = LOOKBACK_HOURS
) -> DataFrame:
    """Rows of the last ``hours`` up to ``now``, both ends included; the scan sees the bounds."""
    upto = as_instant(now)
    since = upto - F.make_dt_interval(hours=F.lit(hours))
    return df.where(F.col(ts_col).between(since, upto))


def filter_min_duration(flat: DataFrame, seconds: float = MIN_DURATION_S) -> DataFrame:
    return flat.where(F.col("duration_s") > F.lit(float(seconds)))


def filter_queue_or_slow(
    flat: DataFrame,
    wait_ms: float = QUEUE_FILTER_WAIT_MS,
    duration_s: float = QUEUE_FILTER_DURATION_S,
) -> DataFrame:
    return flat.where(
        (F.col("admission_wait_ms") > F.lit(float(wait_ms)))
        | (F.col("duration_s") > F.lit(float(duration_s)))
    )


def label_queries(flat: DataFrame) -> DataFrame:
    """Flags as the words that the report shows."""
    return flat.withColumns(
        {
            "spilled_label": F.when(F.col("spilled"), "YES").otherwise("No"),
            "stats_label": F.when(F.col("stats_missing"), "MISSING").otherwise("Ok"),
        }
    )


def cap_records(flat: DataFrame, n: int, order: str = "query_id") -> DataFrame:
    """The first ``n`` records by ``order``; no report applies it."""
    return top_k(flat, n, F.col(order))


def workload_total(flat: DataFrame) -> DataFrame:
    """One row with the number of records; no row when there are none."""
    return flat.agg(F.count(F.lit(1)).alias("total")).where("total > 0")


def bottleneck_overview(flat: DataFrame, wording: str = "short") -> DataFrame:
    """``issue, count, pct, action`` per bottleneck, in report order; nothing on empty input."""
    texts = BOTTLENECKS[wording]
    totals = flat.agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(c) for c, _, _ in texts]
    ).where("total > 0")
    rows = F.array(
        *[
            F.struct(
                F.lit(issue).alias("issue"),
                F.col(column).alias("count"),
                pct(F.col(column), F.col("total")).alias("pct"),
                F.lit(action).alias("action"),
            )
            for column, issue, action in texts
        ]
    )
    return totals.select(F.inline(rows))


def top_slow_queries(flat: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` longest queries; equal durations go by query id."""
    shown = label_queries(flat).select(
        "user",
        "duration_s",
        F.col("spilled_label").alias("spilled"),
        F.col("stats_label").alias("stats"),
        "query_id",
    )
    return top_k(shown, k, F.desc("duration_s"), F.asc("query_id"))


def workload_by_user(flat: DataFrame, k: int | None = 5) -> DataFrame:
    """Total duration, queries and spills per user; the top ``k``, or all for ``None``."""
    users = (
        flat.groupBy("user")
        .agg(
            F.sum("duration_ms").alias("total_ms"),
            F.count(F.lit(1)).alias("query_count"),
            F.count_if("spilled").alias("spill_count"),
        )
        .select(
            "user",
            ms_to_s(F.col("total_ms")).alias("total_duration_s"),
            "query_count",
            "spill_count",
        )
    )
    return users if k is None else top_k(users, k, F.desc("total_duration_s"), F.asc("user"))


def queue_congestion(flat: DataFrame, alert_s: float = QUEUE_ALERT_S) -> DataFrame:
    """The longest admission wait and whether it calls for an alert; nothing on empty input."""
    longest = flat.agg(F.max("admission_wait_s").alias("max_wait_s")).where(
        F.col("max_wait_s").isNotNull()
    )
    return longest.withColumn("alert", F.col("max_wait_s") > F.lit(float(alert_s)))


def queue_by_coordinator(flat: DataFrame) -> DataFrame:
    """Load per coordinator, the busiest first."""
    hosts = flat.groupBy("coordinator").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("queued").alias("queued"),
        F.sum("admission_wait_ms").alias("wait_ms"),
    )
    return hosts.select(
        "coordinator",
        "total",
        "queued",
        pct(F.col("queued"), F.col("total")).alias("pct_queued"),
        (F.col("wait_ms") / F.col("total")).alias("avg_wait_ms"),
    ).orderBy(F.desc("total"), F.asc("coordinator"))


def queue_by_pool(flat: DataFrame) -> DataFrame:
    """Pressure per resource pool, the most queued first."""
    pools = flat.groupBy("pool").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("queued").alias("queued")
    )
    return pools.select(
        "pool", "total", "queued", pct(F.col("queued"), F.col("total")).alias("pct_queued")
    ).orderBy(F.desc("queued"), F.asc("pool"))
