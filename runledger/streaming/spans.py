"""Spans from a stream of log lines: registers in Spark's state, changed spans upserted into a stored table.

Each job has a key in the state, with its registers. A batch's events of a job go through its registers in
order and come out as span changes; no other job's state is read or written, and that of a job that has been
silent for long expires. The changes of a batch are reduced to one row per span and merged into the table's
partitions that hold these jobs. Merging is by the number of the line that brought a value, so a batch that is
run again leaves the table as it is.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from runledger.functions.times import local_time
from runledger.operators.spans import NUMBER, SPANS, collapse, finish, merge, route
from runledger.session import ROCKSDB, STATE_STORE, setting, stored
from runledger.sources.logs import decode_events
from runledger.sources.store import change_table

# Fixed value: how often a log is looked at.
POLL = "5 seconds"
#: How long the registers of a job without a line are kept.
KEEP_MS = 30 * 24 * 3600 * 1000
#: Partitions of a stored span table: a batch rewrites those that hold its jobs.
BUCKETS = 64


def events_of_lines(lines: DataFrame, job: Column | None = None, seq: Column | None = None) -> DataFrame:
    """Typed events of a stream from :func:`tail_lines`.

    The job is the name of the file's folder, the place of a line its number, or what ``job`` and ``seq`` make of
    ``file``, ``at`` and ``line``. An event without a time gets that of its batch, which the checkpoint remembers, so
    a batch that is run again gives the same events.
    """
    job = F.regexp_extract("file", "([^/]+)/[^/]*$", 1) if job is None else job
    rows = lines.select(job.alias("job_uuid"), (F.col("at") + 1 if seq is None else seq).alias("seq"), "line")
    return decode_events(rows, local_time(F.current_timestamp()))[0]


#: What an event carries into the span that it opens, closes or measures.
PAYLOAD = {
    "ts": "timestamp_ntz", "config": "string", "duration": "string", "epoch": "int", "metrics": "string", "model_path": "string",
    "optimizer_path": "string", "dataset": "string", "training_name": "string", "model_epoch": "string", "metrics_json_path": "string",
}
CHANGES = "job_uuid string, phase string, span_seq long, kind string, seq long, parent_seq long, number int, " + ", ".join(
    f"{name} {kind}" for name, kind in PAYLOAD.items()
)
CHANGE = Row("job_uuid", "phase", "span_seq", "kind", "seq", "parent_seq", "number", *PAYLOAD)
MEASURED = ("EVAL_MODEL", "EVAL_TRAINING")


class SpanRegisters(StatefulProcessor):
    """A job's registers, read and written once a batch, and what its events do to spans by the rules of the batch operators."""

    names = [spec.register for spec in SPANS.values()] + [NUMBER]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("registers", ", ".join(f"{name} long" for name in self.names), ttlDurationMs=KEEP_MS)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = dict(zip(self.names, self.state.get() if self.state.exists() else [None] * len(self.names)))
        for row in sorted(rows, key=lambda r: r.seq):  # a batch's events of one job
            change = self.apply(row, held)
            if change is not None:
                yield change
        self.state.update(tuple(held.values()))

    def apply(self, row: Row, held: dict[str, int | None]) -> Row | None:
        spec = SPANS[row.phase]
        open_ = held[spec.register]
        parent = held[SPANS[spec.parent].register] if spec.parent else None
        number = row.number if spec.own_number else held[NUMBER]
        change = None
        if row.event == "start" and self.allowed(spec, row, held):
            change = "start", row.seq
        elif open_ is not None and row.ends:
            change = "end", open_
        elif open_ is not None and row.event == "metrics" and row.phase in MEASURED:
            change = "metrics", open_
        if change and change[0] == "start":
            held[spec.register] = row.seq
            if row.phase == "ITERATION":
                held[NUMBER] = row.number
        elif row.ends and spec.clears:
            held[spec.register] = None
        if change is None:
            return None
        kind, span = change
        return CHANGE(row.job_uuid, row.phase, span, kind, row.seq, parent, number, *[row[name] for name in PAYLOAD])

    @staticmethod
    def allowed(spec, row: Row, held: dict[str, int | None]) -> bool:
        numbered = held[NUMBER] is not None
        if spec.level == 2:
            return numbered and held[SPANS["ITERATION"].register] is not None
        if spec.phase == "EPOCH_TRAIN":
            return numbered and row.epoch is not None and held[SPANS["TRAINING"].register] is not None
        return spec.parent is None or held[SPANS[spec.parent].register] is not None

    def close(self) -> None:
        pass


def stream_changes(events: DataFrame) -> DataFrame:
    """Span changes of a stream of typed events; needs the RocksDB state store.

    A trigger's events of one job are sorted in one task, so bound what a trigger reads for jobs that write much.
    """
    ends = F.coalesce(F.expr(" OR ".join(spec.ends for spec in SPANS.values())), F.lit(False)).alias("ends")
    rows = route(events).select("job_uuid", "phase", "event", "seq", "number", ends, *PAYLOAD)
    return rows.groupBy("job_uuid").transformWithState(
        statefulProcessor=SpanRegisters(), outputStructType=CHANGES, outputMode="Update", timeMode="ProcessingTime"
    )


def upsert_spans(changes: DataFrame, table: str, query: str, batch_id: int, buckets: int = BUCKETS) -> int:
    """Merge span changes into a stored table and return the rows of the partitions written.

    The table is partitioned by a hash of the job and made where it is missing. Each row tells the last batch, by
    query and number, that brought it something. Changes that the table has already leave it the same.
    """
    spark = changes.sparkSession
    batch = F.struct(F.lit(query).alias("query"), F.lit(batch_id).cast("long").alias("id"))
    bucket = F.pmod(F.xxhash64("job_uuid"), F.lit(buckets)).cast("int").alias("bucket")
    new = stored(collapse(changes).select("*", batch.alias("batch"), bucket), "spans")
    if not spark.catalog.tableExists(table):
        new.limit(0).write.partitionBy("bucket").saveAsTable(table)
    if new.isEmpty():
        return 0
    names = spark.table(table).columns
    return change_table(
        spark, table, "bucket", new, ["job_uuid"], lambda rows: merge(rows.unionByName(new)).select("*", bucket).select(*names), moves=False
    )


def stream_spans(
    events: DataFrame, table: str, checkpoint: str, trigger: dict[str, object] | None = None, buckets: int = BUCKETS
) -> StreamingQuery:
    """Start the query that keeps a stored table of spans up to date with a stream of typed events."""

    def sink(changes: DataFrame, batch_id: int) -> None:
        upsert_spans(changes, table, checkpoint, batch_id, buckets)

    writer = stream_changes(events).writeStream.foreachBatch(sink).outputMode("update").option("checkpointLocation", checkpoint)
    with setting(events.sparkSession, STATE_STORE, ROCKSDB):
        return writer.trigger(**(trigger or {"processingTime": POLL})).start()


def current_spans(spark: SparkSession, table: str) -> DataFrame:
    """All spans as of the batches that the table has."""
    return finish(spark.table(table).drop("batch", "bucket"))
