"""Compile times from server logs: classify lines, pair START with END, aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from opsframe.functions import (
    count_union_all,
    hour_key,
    parse_log_timestamp,
    strip_ws,
    truncate_query,
)

# The patterns that a START and an END line must match, and the defaults.
# Part of both patterns, in letters that no other letter equals in any case.
COMPILE_WORDS = "ng command(query"
START_PATTERN = (
    r"(?isU)Compiling command\(queryId=([^)]+)\).*?user=([^;]+);.*?query=(.*)$"
)
END_PATTERN = r"(?isU)Completed compiling command\(queryId=([^)]+)\).*?compileTime=(\d+)ms"
COMPILE_THRESHOLD_MS = 10000
UNION_THRESHOLD = 3

START, END = "START", "END"

_CHUNK = ["file_rank", "block"]
_PLACE = [*_CHUNK, "line_no"]

# Parts over which the events of a query id are dealt that meet nothing outside their chunk.
_PARTS = 1 << 16


def classify_log_lines(lines: DataFrame, max_query_len: int | None = None) -> DataFrame:
    """START and END lines as events; other lines are dropped.

    START is tested first: a "Completed ..." line that also names a user and a query is a
    START. ``compile_ms`` is null for an END whose number no bigint can hold. UNION ALL is counted
    in the whole query text; ``max_query_len`` shortens the text that is kept.
    """
    line = F.col("line")
    is_start = F.col("start_id") != ""

    def group(pattern: str, n: int) -> Column:
        return F.regexp_extract(line, pattern, n)

    # A cheap look drops nearly all lines before the long patterns run. Those run once for
    # each part of a line: a filter on plain columns would move below them and run them a
    # second time, it cannot move below a generator.
    parts = (
        lines.where(F.lower(line).contains(COMPILE_WORDS))
        .select(
            *_PLACE,
            "source_log",
            line,
            F.inline(F.array(F.struct(group(START_PATTERN, 1).alias("start_id")))),
        )
        .select(
            *_PLACE,
            "source_log",
            F.when(is_start, START).otherwise(END).alias("kind"),
            F.inline(
                F.array(
                    F.struct(
                        F.when(is_start, F.col("start_id"))
                        .otherwise(group(END_PATTERN, 1))
                        .alias("query_id"),
                        F.when(is_start, group(START_PATTERN, 2)).alias("user"),
                        F.when(is_start, group(START_PATTERN, 3)).alias("query"),
                        F.when(~is_start, group(END_PATTERN, 2)).alias("compile_text"),
                        parse_log_timestamp(line).alias("ts"),
                    )
                )
            ),
        )
        .where("query_id <> ''")
        .select(
            *_PLACE,
            "source_log",
            "kind",
            strip_ws(F.col("query_id")).alias("query_id"),
            strip_ws(F.col("user")).alias("user"),
            strip_ws(F.col("query")).alias("query"),
            F.col("compile_text").try_cast("bigint").alias("compile_ms"),
            "ts",
        )
    )
    counted = parts.withColumn("union_count", count_union_all(F.col("query")))
    if max_query_len is None:
        return counted
    return counted.withColumn("query", truncate_query(F.col("query"), max_query_len))


def event_outcomes(events: DataFrame) -> DataFrame:
    """The events that have an outcome, with ``outcome`` and the START that a pair took.

    An END takes the START right before it, in log order among the readable events of its query
    id: it is a ``pair`` with that as ``start``, or an ``orphan``. A START that no END takes is
    ``unfinished``, or ``replaced`` by the START behind it; one that is taken is left out, as its
    pair has it. An END whose time is unreadable is an ``error`` and changes nothing.

    Neighbours are looked for inside one (query id, log chunk) first, so that an id with a large
    share of all lines is spread over as many tasks as the log has chunks. The first and the last
    event of each such piece, its edges, then meet those of the id's other chunks; all other
    events pass this second window in parts of their own.
    """
    is_error = (F.col("kind") == END) & F.col("compile_ms").isNull()
    start = F.struct("kind", "user", "query", "union_count", "ts")
    in_chunk = Window.partitionBy("query_id", *_CHUNK, "is_error").orderBy("line_no")
    near = events.withColumn("is_error", is_error).withColumns(
        {"start": F.lag(start).over(in_chunk), "next_kind": F.lead("kind").over(in_chunk)}
    )
    is_first, is_last = F.col("start").isNull(), F.col("next_kind").isNull()
    is_edge = ~F.col("is_error") & (is_first | is_last)
    is_taken = (F.col("kind") == START) & (F.col("next_kind") == END)
    alone = F.pmod(F.xxhash64(*_PLACE), F.lit(_PARTS)).cast("int")
    part = F.when(is_edge, F.lit(-1)).otherwise(alone)
    near = near.withColumns({"is_edge": is_edge, "part": part})
    near = near.where(F.col("is_edge") | ~F.coalesce(is_taken, F.lit(False)))

    over_id = Window.partitionBy("query_id", "part").orderBy(*_PLACE)
    far_start, far_kind = F.lag(start).over(over_id), F.lead("kind").over(over_id)
    both = near.withColumns({"far_start": far_start, "far_kind": far_kind})
    joined = both.withColumns(
        {
            "start": F.when(F.col("is_edge") & is_first, F.col("far_start")).otherwise(F.col("start")),
            "next_kind": F.when(F.col("is_edge") & is_last, F.col("far_kind")).otherwise(
                F.col("next_kind")
            ),
        }
    )
    outcome = (
        F.when(F.col("is_error"), "error")
        .when((F.col("kind") == END) & (F.col("start.kind") == START), "pair")
        .when(F.col("kind") == END, "orphan")
        .when(F.col("next_kind").isNull(), "unfinished")
        .when(F.col("next_kind") == START, "replaced")
    )
    return (
        joined.withColumn("outcome", outcome)
        .where("outcome IS NOT NULL")
        .select(*events.columns, "start", "outcome")
    )


def compile_records(outcomes: DataFrame) -> DataFrame:
    """The pairs of ``event_outcomes`` as one record each."""
    return outcomes.where("outcome = 'pair'").select(
        "query_id",
        F.col("start.user").alias("user"),
        F.col("compile_ms").alias("compile_time_ms"),
        F.col("start.union_count").alias("union_count"),
        F.col("start.ts").alias("start_ts"),
        F.col("ts").alias("end_ts"),
        "source_log",
        F.col("start.query").alias("query"),
    )


def pair_compile_events(events: DataFrame) -> DataFrame:
    """Each END with the latest START of its query id that no other END took, in log order."""
    return compile_records(event_outcomes(events))


def open_starts(outcomes: DataFrame) -> DataFrame:
    """START events that no END took, with ``status``: unfinished, or replaced by a later START."""
    return (
        outcomes.where("outcome IN ('unfinished', 'replaced')")
        .withColumnRenamed("outcome", "status")
        .drop("start")
    )


def unfinished_queries(events: DataFrame) -> DataFrame:
    """STARTs that no END took, as ``unfinished`` or as ``replaced`` by a later START."""
    return open_starts(event_outcomes(events)).select(
        "query_id", "user", F.col("ts").alias("start_ts"), "source_log", "query", "status"
    )


def with_compile_flags(
    records: DataFrame,
    compile_threshold_ms: int = COMPILE_THRESHOLD_MS,
    union_threshold: int = UNION_THRESHOLD,
) -> DataFrame:
    """Adds ``slow_compile`` and ``excessive_unions``, both strictly above their threshold."""
    return records.withColumns(
        {
            "slow_compile": F.col("compile_time_ms") > compile_threshold_ms,
            "excessive_unions": F.col("union_count") > union_threshold,
        }
    )


def compile_stats_by_user(records: DataFrame) -> DataFrame:
    totals = records.groupBy("user").agg(
        F.count(F.lit(1)).alias("total_queries"),
        F.count_if("slow_compile").alias("slow_queries"),
        F.count_if("excessive_unions").alias("excessive_union_queries"),
        F.sum("compile_time_ms").alias("total_compile_ms"),
        F.max("compile_time_ms").alias("max_compile_ms"),
    )
    return totals.withColumn("avg_compile_ms", F.col("total_compile_ms") / F.col("total_queries"))


def compile_stats_by_hour(records: DataFrame) -> DataFrame:
    """Per hour of the start, else of the end; records with neither time are left out."""
    at = F.coalesce("start_ts", "end_ts")
    totals = (
        records.where(at.isNotNull())
        .groupBy(hour_key(at).alias("hour"))
        .agg(
            F.count(F.lit(1)).alias("total_queries"),
            F.count_if("slow_compile").alias("slow_queries"),
            F.sum("compile_time_ms").alias("sum_compile_ms"),
        )
    )
    return totals.withColumn("avg_compile_ms", F.col("sum_compile_ms") / F.col("total_queries"))


def log_parse_quality(events: DataFrame) -> DataFrame:
    """One row: unreadable ENDs, ENDs without a START, STARTs without an END, and pairs."""
    return outcome_quality(event_outcomes(events))


def outcome_quality(outcomes: DataFrame) -> DataFrame:
    """The same from the outcomes of events."""

    def n(*what: str) -> Column:
        return F.count_if(F.col("outcome").isin(*what))

    return outcomes.agg(
        n("error").alias("parse_errors"),
        n("orphan").alias("orphan_ends"),
        n("unfinished", "replaced").alias("unfinished_starts"),
        n("pair").alias("pairs"),
    )
