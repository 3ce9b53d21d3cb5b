"""Jobs that stop writing before their project ends, by a processing-time timer per job.

Events are reduced to one row for each job and Arrow batch before they reach a job's state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from runledger.operators.quality import NO_OUTPUT


#: How long an ended job is remembered, so that a late line does not start its timer again.
KEEP_MS = 7 * 24 * 3600 * 1000


def one_per_job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whether each job of a batch has ended in it."""
    for batch in batches:
        found = pa.Table.from_batches([batch]).group_by("job_uuid").aggregate([("ended", "max")])
        yield from found.rename_columns({"ended_max": "ended"}).select(["job_uuid", "ended"]).to_batches()


class StallTimer(StatefulProcessor):
    """Keeps when a job was last heard of, and for a while whether it has ended."""

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ended = handle.getValueState("ended", "ended boolean", ttlDurationMs=KEEP_MS)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        ended = self.ended.exists() and self.ended.get()[0]
        for row in rows:
            ended = ended or row.ended
        self.ended.update((ended,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if not ended:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield Row(job_uuid=key[0], message=NO_OUTPUT)

    def close(self) -> None:
        pass


def stream_stalled(events: DataFrame, timeout_ms: int) -> DataFrame:
    """``(job_uuid, message)`` for each job silent for the timeout; needs the RocksDB state store."""
    return (
        events.select("job_uuid", F.coalesce((F.col("phase") == "PROJECT") & (F.col("event") == "end"), F.lit(False)).alias("ended"))
        .mapInArrow(one_per_job, "job_uuid string, ended boolean")
        .groupBy("job_uuid")
        .transformWithState(
            statefulProcessor=StallTimer(timeout_ms),
            outputStructType="job_uuid string, message string",
            outputMode="Update",
            timeMode="ProcessingTime",
        )
    )
