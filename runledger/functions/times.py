"""Timestamps and durations.

Times are TIMESTAMP_NTZ in the log's own zone, so no result depends on the session zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The log zone is Asia/Kolkata, which has had this one offset since 1945.
LOG_ZONE = "Asia/Kolkata"
LOG_OFFSET = "+05:30"
LOG_OFFSET_MINUTES = 330
# Fixed value: a reported duration above one day is not believed (minutes).
MAX_MINUTES = 24 * 60

_LOCAL_TS = r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"


def parse_local_ts(text: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` to a local time; anything else is null."""
    return F.when(text.rlike(_LOCAL_TS), text.try_cast("timestamp_ntz"))


def event_time(ts: Column, ingest_ts: Column) -> Column:
    """Event time, or the time of reading where the event has none."""
    return F.coalesce(ts, ingest_ts)


def local_time(instant: Column) -> Column:
    """Wall-clock time in the log's zone at an instant, whatever the session's zone."""
    seconds = (F.unix_micros(instant) / F.lit(1_000_000)).cast("decimal(18,6)")
    return F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(mins=F.lit(LOG_OFFSET_MINUTES), secs=seconds)


def iso_local(ts: Column) -> Column:
    """ISO text with the log zone's offset, to the second."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(LOG_OFFSET))


def minutes_between(start: Column, end: Column) -> Column:
    """Minutes from start to end; negative if reversed, null if a side is missing."""
    seconds = (end - start).cast("interval second").cast("decimal(38,6)")
    return seconds.cast("double") / F.lit(60.0)


def span_minutes(start: Column, end: Column) -> Column:
    """Minutes of a span, never below zero and 0.0 where unknown."""
    minutes = minutes_between(start, end)
    return F.when(minutes > 0, minutes).otherwise(F.lit(0.0))


def valid_minutes(raw: Column, start: Column, end: Column) -> Column:
    """A reported duration if it lies in 0..1440, else the span's own minutes.

    A NaN fails neither limit and is kept; Spark orders NaN above every number, so it is
    tested first.
    """
    value = raw.try_cast("double")
    return (
        F.when(F.isnan(value), value)
        .when((value >= 0) & (value <= MAX_MINUTES), value)
        .otherwise(span_minutes(start, end))
    )


def or_minutes(raw: Column, start: Column, end: Column) -> Column:
    """A reported duration unless it is missing or zero, then the span's own minutes."""
    value = raw.try_cast("double")
    missing = raw.isNull() | (raw.cast("string") == "") | (value == 0)
    return F.when(missing, span_minutes(start, end)).otherwise(value)
