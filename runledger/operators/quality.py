"""Counts and checks over log lines and events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.operators.chunks import MAX_ROWS, paged_arrays
from runledger.operators.ranking import tail_rows

# What a failed run is reported as.
FAILED = "Training script failed - check logs for details"
STOPPED = "Training script stopped unexpectedly"
NO_LOG = "Training script stopped and no log file found"
NO_OUTPUT = "Training script stopped without producing logs"


def events_by_phase(events: DataFrame, key: Sequence[str], phase: str = "phase") -> DataFrame:
    return events.groupBy(*key, phase).agg(F.count(F.lit(1)).alias("n"))


def event_lists(
    events: DataFrame, key: Sequence[str], order: str, event: str, page_rows: int = 10_000, max_rows: int = MAX_ROWS
) -> DataFrame:
    """Event names of each key in order, in pages."""
    return paged_arrays(events, key, [order], [event], page_rows, max_rows)


def parse_quality(decoded: DataFrame, blank_lines: DataFrame, iterations: DataFrame, key: Sequence[str]) -> DataFrame:
    """Lines in all, parsed and failed per key, and the verdict.

    ``decoded`` has a ``reason`` on failed lines, ``blank_lines`` a count ``blank`` per key: blank
    lines count as lines but neither as parsed nor as failed.
    """
    counts = decoded.groupBy(*key).agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(F.col("reason").isNull()).alias("parsed"),
        F.count_if(F.col("reason").isNotNull()).alias("failed"),
    )
    spans = iterations.groupBy(*key).agg(F.count(F.lit(1)).alias("iterations"))
    joined = counts.join(blank_lines, list(key), "full").join(spans, list(key), "left")
    number = {c: F.coalesce(c, F.lit(0)) for c in ("lines", "blank", "parsed", "failed", "iterations")}
    return joined.select(
        *key,
        (number["lines"] + number["blank"]).alias("total_lines"),
        number["parsed"].alias("parsed_lines"),
        number["failed"].alias("failed_lines"),
        number["iterations"].alias("iterations"),
        ((number["failed"] == 0) & (number["parsed"] > 0) & (number["iterations"] > 0)).alias("passed"),
    )


def classify_failure(jobs: DataFrame, lines: DataFrame, key: str, order: str, line: str, n: int = 50) -> DataFrame:
    """Failure message per job from its last ``n`` script-log lines; jobs without a log get one too."""
    tail = tail_rows(lines, [key], [order], n)
    found = F.contains(F.col(line), F.lit("Error:")) | F.contains(F.lower(line), F.lit("failed"))
    verdict = tail.groupBy(key).agg(F.bool_or(found).alias("_found"))
    message = F.when(F.col("_found").isNull(), NO_LOG).when(F.col("_found"), FAILED).otherwise(STOPPED)
    return jobs.join(verdict, key, "left").select(key, message.alias("message"))


def stalled_jobs(events: DataFrame, now: str, timeout_minutes: int, key: str, ts: str, ended: str) -> DataFrame:
    """Jobs whose last event is older than the timeout at ``now`` and that never ended."""
    limit = F.expr(f"timestamp_ntz'{now}' - interval '{timeout_minutes}' minute")
    last = events.groupBy(key).agg(F.max(ts).alias("last_ts"), F.bool_or(F.expr(ended)).alias("_ended"))
    return last.where((F.col("last_ts") < limit) & ~F.coalesce("_ended", F.lit(False))).select(
        key, "last_ts", F.lit(NO_OUTPUT).alias("message")
    )
