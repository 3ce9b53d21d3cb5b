"""First, best and last rows per key.

Each is ``row_number() <= n``. Up to LIMITED rows Spark also applies it before the exchange: a map
task sends at most n rows per key, so a heavy key is cut down where its rows are. For more rows a
first rank runs over slices of each key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.session import unused

# Fixed value: a score has to be above this to win.
SCORE_FLOOR = -1.0
#: Rows per key that Spark limits before the exchange by default, and the slices of a key beyond that.
LIMITED, SLICES = 1000, 64


def first_rows(df: DataFrame, key: Sequence[str], order: Sequence[Column | str], n: int = 1) -> DataFrame:
    place = unused(df, "_rank")
    if n > LIMITED:
        slice_ = F.pmod(F.xxhash64(*df.columns), F.lit(SLICES))
        part = F.row_number().over(Window.partitionBy(*key, slice_).orderBy(*order))
        df = df.withColumn(place, part).where(F.col(place) <= n).drop(place)
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn(place, rank).where(F.col(place) <= n).drop(place)


def argmax_first(
    df: DataFrame, key: Sequence[str], value: str, tie: Sequence[str], floor: float = SCORE_FLOOR
) -> DataFrame:
    """Row with the highest value per key, the first by ``tie`` among equals.

    Values at or below ``floor``, NaN and nulls never win; a key with no other has no row.
    """
    eligible = df.where((F.col(value) > floor) & ~F.isnan(F.col(value).cast("double")))
    return first_rows(eligible, key, [F.desc(value), *tie])


def last_wins(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key."""
    return first_rows(df, key, [F.desc(c) for c in order])


def tail_rows(df: DataFrame, key: Sequence[str], order: Sequence[str], n: int = 50) -> DataFrame:
    """The last ``n`` rows of each key."""
    return first_rows(df, key, [F.desc(c) for c in order], n)


def latest_completed(iterations: DataFrame, key: str, number: str, completed: str, tie: str) -> DataFrame:
    """Completed iteration with the highest number per job; the first by ``tie`` among equals."""
    done = iterations.where(F.col(completed).isNotNull())
    return first_rows(done, [key], [F.desc(number), tie])


def passing_keys(df: DataFrame, key: Sequence[str], ok: Column) -> DataFrame:
    """Keys of which every row passes: one failing or unknown row voids its whole key."""
    return df.groupBy(*key).agg(F.bool_and(F.coalesce(ok, F.lit(False))).alias("_ok")).where("_ok").drop("_ok")
