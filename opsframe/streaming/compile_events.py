"""START/END pairing on a stream of log lines.

Each micro-batch runs the batch pairing on its own events and on the STARTs that earlier
batches left open. So stream and batch agree by construction, and a query id with a large
share of the lines is spread over tasks, which one state value per id would not allow.

The open STARTs are a small table per micro-batch below ``out/open``. Every folder is named
by the batch and overwritten when a batch runs again, so a restart repeats no result.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from opsframe.functions import hour_key
from opsframe.operators.logs import (
    COMPILE_THRESHOLD_MS,
    UNION_THRESHOLD,
    classify_log_lines,
    compile_records,
    event_outcomes,
    open_starts,
    with_compile_flags,
)
from opsframe.schemas import COMPILE_RECORD_COLUMNS
from opsframe.session import as_instant, delete_folder

RECORD_DDL = (
    "query_id STRING, user STRING, compile_time_ms BIGINT, union_count INT, "
    "slow_compile BOOLEAN, excessive_unions BOOLEAN, start_ts TIMESTAMP_NTZ, "
    "end_ts TIMESTAMP_NTZ, source_log STRING, query STRING"
)
UNFINISHED_DDL = (
    "query_id STRING, user STRING, start_ts TIMESTAMP_NTZ, source_log STRING, "
    "query STRING, status STRING"
)
EVENT_DDL = (
    "file_rank STRUCT<batch: BIGINT, rank: STRING>, block BIGINT, line_no BIGINT, "
    "source_log STRING, kind STRING, query_id STRING, user STRING, query STRING, "
    "compile_ms BIGINT, ts TIMESTAMP_NTZ, union_count INT"
)


def stream_compile_records(
    lines_stream: DataFrame,
    out: str,
    checkpoint: str,
    ttl_s: int | None = None,
    available_now: bool = True,
    compile_threshold_ms: int = COMPILE_THRESHOLD_MS,
    union_threshold: int = UNION_THRESHOLD,
    max_query_len: int | None = None,
) -> StreamingQuery:
    """Start the pairing: records go to ``out/records``, given-up STARTs to ``out/unfinished``.

    ``ttl_s`` gives up STARTs that are older, in log time, than the newest line seen; a START
    without a time ages from the batch that read it. Without it open STARTs are kept for good.
    An END that comes after its START was given up pairs with nothing.
    """
    spark = lines_stream.sparkSession

    def run(lines: DataFrame, batch: int) -> None:
        place = F.struct(
            F.lit(batch).cast("bigint").alias("batch"),
            F.col("file_rank").cast("string").alias("rank"),
        )
        if "line_no" not in lines.columns:
            lines = lines.withColumn("line_no", F.monotonically_increasing_id())
        events = classify_log_lines(lines, max_query_len).withColumn("file_rank", place)
        events = events.select(*_names(EVENT_DDL))
        if batch > 0:
            open_before = spark.read.schema(EVENT_DDL).parquet(f"{out}/open/batch={batch - 1}")
            events = open_before.unionByName(events)
        seen = Observation()
        events = events.observe(seen, F.max("ts").alias("newest"))
        # Written once, so that lines are read and paired once for records and open STARTs.
        work = f"{out}/work/batch={batch}"
        event_outcomes(events).write.mode("overwrite").parquet(work)
        emit(spark.read.parquet(work), seen.get["newest"], batch)
        delete_folder(spark, work)

    def emit(outcomes: DataFrame, newest: datetime | None, batch: int) -> None:
        records = with_compile_flags(
            compile_records(outcomes), compile_threshold_ms, union_threshold
        ).select(*COMPILE_RECORD_COLUMNS)
        records.write.mode("overwrite").parquet(f"{out}/records/batch={batch}")

        waiting = open_starts(outcomes).where("status = 'unfinished'")
        if ttl_s is not None:
            now = as_instant(newest)
            limit = now - F.make_dt_interval(secs=F.lit(ttl_s))
            aged = waiting.withColumn("ts", F.coalesce("ts", now))
            gone = F.coalesce(F.col("ts") < limit, F.lit(False))
            aged.where(gone).select(
                "query_id",
                "user",
                F.col("ts").alias("start_ts"),
                "source_log",
                "query",
                F.lit("expired").alias("status"),
            ).write.mode("overwrite").parquet(f"{out}/unfinished/batch={batch}")
            waiting = aged.where(~gone)
        waiting.drop("status").write.mode("overwrite").parquet(f"{out}/open/batch={batch}")
        # A batch that runs again reads the set before it; older ones are of no use.
        if batch > 1:
            delete_folder(spark, f"{out}/open/batch={batch - 2}")

    writer = lines_stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _names(ddl: str) -> list[str]:
    """Top-level column names of a DDL text."""
    return StructType.fromDDL(ddl).names


def record_stream(spark: SparkSession, out: str) -> DataFrame:
    """The paired records as a stream, as batches of the pairing finish."""
    return spark.readStream.schema(RECORD_DDL).parquet(f"{out}/records/*")


def stream_unfinished(spark: SparkSession, out: str) -> DataFrame:
    """The given-up STARTs as a stream."""
    return spark.readStream.schema(UNFINISHED_DDL).parquet(f"{out}/unfinished/*")


def stream_compile_stats_by_hour(records_stream: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Hourly windows by start time, else end time; records with neither are left out.

    A watermark needs an instant: the zone-free times are taken as UTC.
    """
    at = F.coalesce("start_ts", "end_ts")
    totals = (
        records_stream.withColumns(
            {"at": F.concat(at.cast("string"), F.lit("Z")).cast("timestamp"), "hour": hour_key(at)}
        )
        .where("at IS NOT NULL")
        .withWatermark("at", watermark)
        .groupBy(F.window("at", "1 hour"), "hour")
        .agg(
            F.count(F.lit(1)).alias("total_queries"),
            F.count_if("slow_compile").alias("slow_queries"),
            F.sum("compile_time_ms").alias("sum_compile_ms"),
        )
    )
    return totals.select(
        "hour",
        "total_queries",
        "slow_queries",
        "sum_compile_ms",
        (F.col("sum_compile_ms") / F.col("total_queries")).alias("avg_compile_ms"),
    )
