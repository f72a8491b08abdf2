"""Time functions; all on zone-free timestamps, so the session zone does not matter."""

from __future__ import annotations

import calendar
from datetime import datetime, timezone

from pyspark.sql import Column, functions as F

# A day, as the casts of Spark read it, and a time of day behind it, with or without all parts.
_DAY = r"^\s*[+-]?\d{4,7}(-\d{1,2}){0,2}"
_TIME = r"[T ]\d{1,2}:\d{1,2}"
_CLOCK = r"(T|[T ]\d{1,2}(:\d{1,2}(:\d{1,2}(\.\d*)?)?)?)?"

# Fixed value: how a log line with a time begins.
LOG_TIME_PATTERN = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3})"


def parse_log_timestamp(line: Column) -> Column:
    """The time at the very start of the line; null when absent or not a real time."""
    text = F.regexp_extract(line, LOG_TIME_PATTERN, 1)
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("timestamp_ntz")


def hour_key(ts: Column) -> Column:
    """``2024-01-31 23``, from the text form, which knows no zone."""
    return F.substring(ts.cast("string"), 1, len("yyyy-MM-dd HH"))


def iso_ts(ts: Column) -> Column:
    """ISO-8601 text, with six decimals only where the fraction is not zero."""
    text = F.replace(ts.cast("string"), F.lit(" "), F.lit("T"))
    padded = F.rpad(text, len("yyyy-MM-ddTHH:mm:ss.SSSSSS"), "0")
    return F.when(text.contains("."), padded).otherwise(text)


def months_before(now: str | datetime, months: int) -> datetime:
    """``now`` minus calendar months; a day past the month's end becomes its last day."""
    at = datetime.fromisoformat(now) if isinstance(now, str) else now
    year, month0 = divmod(at.year * 12 + at.month - 1 - months, 12)
    day = min(at.day, calendar.monthrange(year, month0 + 1)[1])
    return at.replace(year=year, month=month0 + 1, day=day)


def epoch_ms_cutoff(now: str | datetime, months: int = 1) -> Column:
    """Epoch milliseconds of ``now`` minus ``months``, as a literal that scans can use."""
    cutoff = months_before(now, months)
    cutoff = cutoff.replace(tzinfo=cutoff.tzinfo or timezone.utc)
    micros = (cutoff - datetime(1970, 1, 1, tzinfo=timezone.utc)) // datetime.resolution
    return F.lit(micros // 1000)


def zone_free(text: Column) -> Column:
    """A time as UTC wall time: text with a zone is an instant, text without one stays as it is.

    A zone is whatever follows the time of day and Spark knows: ``Z``, ``+05``, ``+5:30``, ``UTC+3``,
    ``Europe/Paris``, ``EST``. Text that is no date with or without a time, and a zone that is
    unknown, are an error; null stays null.
    """
    epoch = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    # The cast reads a zone only behind seconds.
    full = F.regexp_replace(text, f"({_DAY}{_TIME})(?=[^0-9:])", "$1:00")
    micros = F.unix_micros(full.try_cast("timestamp"))
    instant = epoch + F.make_dt_interval(
        secs=(micros / F.lit(1_000_000).cast("decimal(10,0)")).cast("decimal(18,6)")
    )
    parsed = F.when(text.rlike(f"{_DAY}{_CLOCK}\\s*$"), text.try_cast("timestamp_ntz")).when(
        text.rlike(f"{_DAY}{_TIME}"), instant
    )
    bad = F.raise_error(F.concat(F.lit("no time: "), text))
    return F.when(text.isNotNull(), F.coalesce(parsed, bad))
