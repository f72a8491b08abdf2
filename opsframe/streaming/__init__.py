"""Structured Streaming forms of the log analysis."""

from opsframe.streaming.compile_events import (
    record_stream,
    stream_compile_records,
    stream_compile_stats_by_hour,
    stream_unfinished,
)

__all__ = [
    "record_stream",
    "stream_compile_records",
    "stream_compile_stats_by_hour",
    "stream_unfinished",
]
