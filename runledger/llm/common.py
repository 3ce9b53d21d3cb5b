"""Running totals over a global order, and reading of a text column."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.session import stored

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def running_total(df: DataFrame, order: Sequence[str], value: str, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over all rows up to and including this one, by ``order``.

    A window without a key would put all rows into one task. Here the rows are dealt out in ranges of
    ``order``; a window per range starts from the sum of the ranges before it, one number per range.
    ``order`` has to tell rows apart, or rows alike in it count in any order. Nulls come first.
    """
    ranged = stored(
        df.repartitionByRange(shuffle_partitions(df), *order).withColumn("_range", F.spark_partition_id()), "ranges"
    )
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranged.groupBy("_range")
        .agg(F.sum(value).alias("_sum"))
        .select("_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    )
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        ranged.join(F.broadcast(starts), "_range")  # a row for each range
        .withColumn(name, F.col("_start") + F.sum(value).over(within))
        .drop("_range", "_start")
    )


#: Rows of numbers that a broadcast may hold: some 50 MB at most.
BROADCAST_ROWS = 500_000


def counted_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a stored table of a few numbers a row if a count allows it; beyond, Spark shuffles both sides."""
    return F.broadcast(df) if df.count() <= limit else df


#: What :func:`kept` holds in a Python worker.
KEPT: dict[object, object] = {}


def kept(key: object, make: Callable[[], object]) -> object:
    """The one large object that a Python worker keeps from task to task; asking for another lets it go.

    Workers outlive a stage, so what several operators remember would else add up.
    """
    if key not in KEPT:
        KEPT.clear()
        KEPT[key] = make()
    return KEPT[key]
