import datetime as dt

import pytest
from pyspark.sql import functions as F

from opsframe import plans, sources
from opsframe.operators import workload as w
from opsframe.schemas import QUERY_RECORD_DDL


def raw(spark, *records):
    """Records from ``(id, user, time, attributes, coordinator)``."""
    rows = [
        (query_id, user, "FINISHED", time, attributes, coordinator)
        for query_id, user, time, attributes, coordinator in records
    ]
    return spark.createDataFrame(rows, QUERY_RECORD_DDL)


def one(spark, attributes=None, coordinator=None, user="u"):
    return w.flatten_query_records(raw(spark, ("q", user, None, attributes, coordinator))).first()


def test_defaults(spark):
    row = one(spark, user=None)
    assert (row["user"], row["coordinator"], row["pool"]) == ("unknown", "Unknown", "default")
    assert (row["duration_s"], row["admission_wait_s"], row["rows_inserted"]) == (0.0, 0.0, 0)
    assert (row["spilled"], row["stats_missing"], row["queued"]) == (False, False, False)


@pytest.mark.parametrize(
    "host, expected",
    [(("h", "i"), "h"), (("", "h1"), "h1"), ((None, "h1"), "h1"), (("", ""), "Unknown")],
)
def test_coordinator(spark, host, expected):
    assert one(spark, {}, host)["coordinator"] == expected


def test_pool_and_numbers(spark):
    row = one(
        spark,
        {
            "request_pool": "",
            "pool": "etl",
            "query_duration": "2500",
            "admission_wait": "1000",
            "rows_inserted": "12.0",
            "spilled": "TRUE",
            "planning_wait_time": "bad",
        },
    )
    assert (row["pool"], row["duration_s"], row["rows_inserted"]) == ("etl", 2.5, 12)
    assert (row["queued"], row["spilled"], row["planning_wait_s"]) == (False, True, 0.0)
    assert one(spark, {"admission_wait": "1001"})["queued"] is True


def test_filters_are_strict_and_the_window_is_closed(spark):
    flat = spark.createDataFrame(
        [("a", 5.0, 0.0), ("b", 5.1, 0.0), ("c", 0.5, 100.0), ("d", 0.5, 101.0), ("e", 1.0, 0.0)],
        "query_id STRING, duration_s DOUBLE, admission_wait_ms DOUBLE",
    )
    assert [r[0] for r in w.filter_min_duration(flat).collect()] == ["b"]
    assert [r[0] for r in w.filter_queue_or_slow(flat).collect()] == ["a", "b", "d"]
    now = dt.datetime(2024, 1, 2)
    times = spark.createDataFrame(
        [(now - dt.timedelta(hours=h, microseconds=us),) for h, us in [(0, 0), (24, 0), (24, 1)]],
        "ts TIMESTAMP_NTZ",
    )
    assert w.filter_lookback(times, "ts", now).count() == 2
    aware = now.replace(tzinfo=dt.timezone(dt.timedelta(hours=2))) + dt.timedelta(hours=2)
    assert w.filter_lookback(times, "ts", aware).count() == 2


def test_lookback_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "records")
    raw(spark, ("q", "u", dt.datetime(2024, 1, 1), {}, None)).write.parquet(path)
    recent = w.filter_lookback(spark.read.parquet(path), "startTime", "2024-01-02 00:00:00")
    plan = recent._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert "GreaterThanOrEqual(startTime" in pushed and "LessThanOrEqual(startTime" in pushed


def test_empty_input_gives_empty_reports(spark):
    flat = w.flatten_query_records(raw(spark))
    for report in [
        w.workload_total,
        w.bottleneck_overview,
        w.top_slow_queries,
        w.workload_by_user,
        w.queue_congestion,
        w.queue_by_coordinator,
        w.queue_by_pool,
    ]:
        assert report(flat).count() == 0


def test_overview_wordings(spark):
    flat = w.flatten_query_records(
        raw(spark, ("a", "u", None, {"spilled": "true"}, None), ("b", "u", None, {}, None))
    )
    short = w.bottleneck_overview(flat).collect()
    assert [(r["issue"], r["count"], r["pct"]) for r in short] == [
        ("Spilling to Disk", 1, 50.0),
        ("Missing Table Stats", 0, 0.0),
        ("Admission Queueing", 0, 0.0),
    ]
    long = w.bottleneck_overview(flat, "long").collect()
    assert long[1]["issue"] == "Missing Table Stats (MAJOR)"


def test_pages_and_report(spark, tmp_path):
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages" / "1.json").write_text(
        """{"queries": [
          {"queryId": "a", "user": "ann", "startTime": "2024-01-01T12:00:00.000",
           "attributes": {"query_duration": 9000, "spilled": true, "admission_wait": "6000"},
           "coordinator": {"hostname": "h1"}},
          {"queryId": "b", "startTime": "2024-01-01T12:00:00.000",
           "attributes": {"query_duration": "7000"}}]}"""
    )
    (tmp_path / "pages" / "2.json").write_text('{"queries": []}')
    records = sources.scan_query_records(spark, str(tmp_path / "pages"))
    report = plans.workload_report(records, "2024-01-02 00:00:00")
    assert report["total"].first()[0] == 2
    assert [r["user"] for r in report["users"].collect()] == ["ann", "unknown"]
    assert tuple(report["congestion"].first()) == (6.0, True)
    slowest = report["slowest"].first()
    assert (slowest["query_id"], slowest["spilled"], slowest["stats"]) == ("a", "YES", "Ok")
    queues = plans.queue_report(records, "2024-01-02 00:00:00")
    first = queues["coordinators"].first()
    assert (first["total"], first["coordinator"]) == (1, "Unknown")
    assert queues["pools"].first()["queued"] == 1


def test_top_k_is_not_a_full_sort(spark):
    flat = w.flatten_query_records(raw(spark, ("a", "u", None, {}, None)))
    plan = w.top_slow_queries(flat)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_cap(spark):
    flat = spark.range(20).select(F.col("id").alias("query_id"))
    assert [r[0] for r in w.cap_records(flat, 3).collect()] == [0, 1, 2]
