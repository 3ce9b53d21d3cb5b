"""One level of spans over any table: open and close conditions, key and order as parameters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.functions.times import span_minutes
from runledger.operators.chunks import MAX_ROWS
from runledger.operators.registers import Register, with_registers


def pair_changes(df: DataFrame, key: Sequence[str], order: str, ts: str, start: Column, end: Column, held: str) -> DataFrame:
    """One row per span from rows that know their open span in column ``held``."""
    start, end = F.coalesce(start, F.lit(False)), F.coalesce(end, F.lit(False)) & F.col(held).isNotNull()
    rows = df.where(start | end).select(
        *key,
        F.when(start, F.col(order)).otherwise(F.col(held)).alias("start_seq"),
        F.when(start, F.col(ts)).alias("_start_ts"),
        F.when(~start, F.col(order)).alias("_end_seq"),
        F.col(ts).alias("_ts"),
    )
    spans = rows.groupBy(*key, "start_seq").agg(
        F.max("_start_ts").alias("start_ts"),
        F.max("_end_seq").alias("end_seq"),
        F.max_by("_ts", "_end_seq").alias("end_ts"),
    )
    minutes = F.when(F.col("end_seq").isNotNull(), span_minutes(F.col("start_ts"), F.col("end_ts")))
    return spans.withColumn("minutes", minutes)


def span_pairs(
    df: DataFrame, key: Sequence[str], order: str, ts: str, opens: Column, closes: Column, clears: bool = True,
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """Spans from each opening row to the row closing it, by ``order`` within ``key``.

    A new opening replaces an open span, which stays without an end. With ``clears`` the first
    closing row ends a span, without it the last one before the next opening.
    """
    rows = df.where(opens | closes).withColumn("_opens", opens).withColumn("_closes", closes & ~opens)
    register = Register(F.col("_opens"), F.col(order), F.col("_closes") if clears else None)
    tracked = with_registers(rows, [lambda _: {"_open": register}], key, [order], max_rows=max_rows)
    return pair_changes(tracked, key, order, ts, F.col("_opens"), F.col("_closes"), "_open")
