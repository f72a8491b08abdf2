"""From log files to per-query records and their statistics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from opsframe.operators.logs import (
    COMPILE_THRESHOLD_MS,
    UNION_THRESHOLD,
    classify_log_lines,
    compile_records,
    compile_stats_by_hour,
    compile_stats_by_user,
    event_outcomes,
    outcome_quality,
    with_compile_flags,
)
from opsframe.schemas import COMPILE_RECORD_COLUMNS
from opsframe.session import discard, staged
from opsframe.sinks import write_csv, write_summary_json
from opsframe.sources import scan_log_lines


@dataclass(frozen=True)
class CompileLogReport:
    records: DataFrame
    per_user: DataFrame
    per_hour: DataFrame
    quality: DataFrame
    thresholds: dict[str, int]
    tables: tuple[DataFrame, ...] = ()

    def write(self, csv_path: str, summary_path: str) -> None:
        """The records as CSV, the statistics as a JSON summary."""
        write_csv(self.records, csv_path, COMPILE_RECORD_COLUMNS)
        errors = self.quality.select("parse_errors").first()[0]
        meta = {**self.thresholds, "parse_errors": errors}
        write_summary_json(self.per_user, self.per_hour, meta, summary_path)

    def close(self) -> None:
        """Delete what the report staged; its results cannot be read afterwards."""
        discard(*self.tables)


def compile_log_report(
    spark: SparkSession,
    paths: str | Sequence[str],
    compile_threshold_ms: int = COMPILE_THRESHOLD_MS,
    union_threshold: int = UNION_THRESHOLD,
    max_query_len: int | None = None,
    stage: bool = True,
) -> CompileLogReport:
    """Per-query compile records with per-user and per-hour statistics.

    ``stage`` keeps the outcomes of all events in the shared folder, so that the logs are read
    and paired once for all four results; without it each result is a plan of its own.
    """
    outcomes = event_outcomes(classify_log_lines(scan_log_lines(spark, paths), max_query_len))
    if stage:
        outcomes = staged(outcomes, "compile-outcomes")
    records = with_compile_flags(compile_records(outcomes), compile_threshold_ms, union_threshold)
    return CompileLogReport(
        records=records.select(*COMPILE_RECORD_COLUMNS),
        per_user=compile_stats_by_user(records),
        per_hour=compile_stats_by_hour(records),
        quality=outcome_quality(outcomes),
        thresholds={
            "compile_threshold_ms": compile_threshold_ms,
            "union_threshold": union_threshold,
        },
        tables=(outcomes,) if stage else (),
    )
