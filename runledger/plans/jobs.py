"""Job rows from requests, and their life cycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.functions.payload import text_at
from runledger.functions.times import minutes_between
from runledger.operators.best import set_in_json
from runledger.operators.chunks import MAX_ROWS
from runledger.operators.registers import Register, with_registers
from runledger.schemas import TERMINAL_STATUSES
from runledger.sources.requests import unwrap_request


def jobs_from_requests(requests: DataFrame, now: Column, identity: Column) -> DataFrame:
    """Pending job per request ``document``; its key is a hash of ``identity``, so reruns agree."""
    request = F.col("_request")
    return requests.withColumn("_request", unwrap_request(F.col("document"))).select(
        F.sha2(identity, 256).alias("uuid"),
        now.alias("created_at"),
        text_at(request, "$.project.id").alias("project_id"),
        text_at(request, "$.training_run_id").alias("training_run_id"),
        F.to_json("document").alias("training_request"),
        F.lit("pending").alias("status"),
    )


def effective_transitions(jobs: DataFrame, transitions: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """Transitions ``(uuid, seq, status, at, error)`` that change their job.

    A cancel on a job that is over is void; whether it is over shows in the row before, since a
    cancel leaves the job over in any case. The first transition looks at the job's own status.
    """
    initial = jobs.select("uuid", F.struct(F.col("status").alias("v")).alias("_before"))
    register = {"_before": Register(F.lit(True), F.col("status"))}
    seen = with_registers(transitions, [lambda _: register], ["uuid"], ["seq"], initial, max_rows)
    void = (F.col("status") == "cancelled") & F.col("_before").isin(*TERMINAL_STATUSES)
    return seen.where(~F.coalesce(void, F.lit(False))).drop("_before")


def apply_transitions(jobs: DataFrame, transitions: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """Jobs after their transitions: status, times, minutes taken and the error note."""
    status, at, seq = F.col("status"), F.col("at"), F.col("seq")
    over = status.isin(*TERMINAL_STATUSES)
    last = (
        effective_transitions(jobs, transitions, max_rows)
        .groupBy("uuid")
        .agg(
            F.max_by(status, seq).alias("_status"),
            F.max_by(at, F.when(status == "running", seq)).alias("_started"),
            F.max_by(at, F.when(over, seq)).alias("_completed"),
            F.max_by(F.col("error"), F.when((status == "failed") & F.col("error").isNotNull(), seq)).alias("_error"),
        )
    )
    changed = (
        jobs.join(last, "uuid", "left")
        .withColumn("status", F.coalesce("_status", "status"))
        .withColumn("started_at", F.coalesce("_started", "started_at"))
        .withColumn("completed_at", F.coalesce("_completed", "completed_at"))
    )
    minutes = minutes_between(F.col("created_at"), F.col("completed_at"))
    minutes = F.when(F.col("_completed").isNotNull(), minutes).otherwise(F.col("time_taken"))
    changed = changed.withColumn("time_taken", minutes)
    metadata, note = F.col("job_metadata"), F.to_json(F.col("_error").try_cast("variant"))
    noted = F.when(F.col("_error").isNotNull(), set_in_json(metadata, "error", note)).otherwise(metadata)
    return changed.withColumn("job_metadata", noted).drop("_status", "_started", "_completed", "_error")


def job_outcomes(spans: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """One row per job: success where its project has ended, else the message of its failure.

    ``failures`` has ``job_uuid`` and ``message`` of every job that is over, as ``classify_failure`` gives
    them; without it only successes are told.
    """
    done = spans.where((F.col("phase") == "PROJECT") & F.col("completed_at").isNotNull())
    done = done.groupBy("job_uuid").agg(F.max("completed_at").alias("completed_at"))
    if failures is None:
        return done.select("job_uuid", "completed_at", F.lit(True).alias("success"), F.lit(None).cast("string").alias("message"))
    success = F.col("completed_at").isNotNull()
    return done.join(failures.select("job_uuid", "message"), "job_uuid", "full").select(
        "job_uuid", "completed_at", success.alias("success"), F.when(~success, F.col("message")).alias("message")
    )
