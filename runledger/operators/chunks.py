"""Splitting the rows of a heavy key into ordered chunks.

A window partitioned by key alone puts all rows of a key into one task. Where a key holds more
than ``max_rows`` rows, each of its rows gets the number of its chunk, and windows run per (key,
chunk). Rows of all other keys carry a null chunk, so they stay together.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType

from runledger.session import stored

MAX_ROWS = 2_000_000

CHUNK = "_chunk"


def heavy_keys(df: DataFrame, key: Sequence[str], max_rows: int) -> DataFrame:
    """Keys with more than ``max_rows`` rows: at most (all rows / max_rows) of them."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > max_rows)


def places(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``key, order, _rank, _rows``: of each distinct order tuple its first row's number, and its key's rows.

    Tuples are dealt out in ranges of (key, order) and numbered there; sums per range and key say how
    many rows of the key come before the range. No task holds more than a range, however heavy a key is.
    """
    tuples = [*key, *order]
    counted = df.groupBy(*tuples).agg(F.count(F.lit(1)).alias("_n"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(counted.repartitionByRange(n, *tuples).withColumn("_range", F.spark_partition_id()), "ranges")
    of_key = Window.partitionBy(*key)
    before = of_key.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(*key, "_range").agg(F.sum("_n").alias("_sum")).select(
        *[F.col(c).alias(f"_of_{c}") for c in (*key, "_range")],
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"), F.sum("_sum").over(of_key).alias("_rows"),
    )
    inside = Window.partitionBy(*key, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = ranged.withColumn("_place", F.sum("_n").over(inside) - F.col("_n") + 1)
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in (*key, "_range")]
    return numbered.join(sums, same).select(*tuples, (F.col("_place") + F.col("_before")).alias("_rank"), "_rows")


#: Kinds of order columns that a sketch of quantiles takes.
SKETCHED = (NumericType, DateType, TimestampType, TimestampNTZType)
#: Chunks are aimed at this part of ``max_rows``, and the sketch errs by so many parts of a chunk.
FILLED, FINE = 0.5, 20
#: Chunks that a sketch is asked for at most; a key that needs more is cut by places.
MOST = 4096


def cuts(rows: DataFrame, key: Sequence[str], first: str, heavy: DataFrame, max_rows: int) -> DataFrame:
    """``key, _cuts``: for each heavy key the ascending values of ``first`` after which a chunk ends.

    One sketch of quantiles per key and task, merged, serves all keys: its grid is that of the heaviest, and a
    lighter key takes every so many-th value of it. In all there are about 2 values for each ``max_rows`` rows.
    """
    most = heavy.agg(F.max("_rows")).first()[0]
    parts = min(MOST, max(2, math.ceil(most / (FILLED * max_rows))))
    grid = [n / parts for n in range(1, parts)]
    sketched = rows.groupBy(*key).agg(F.percentile_approx(first, grid, min(FINE * parts, 2**31 - 1)).alias("_grid"), F.count(F.lit(1)).alias("_rows"))
    step = F.greatest(F.lit(1), F.floor(F.lit(FILLED * max_rows * parts) / F.col("_rows"))).cast("int")
    places = F.sequence(step, F.lit(parts - 1), step)
    taken = F.when(step <= parts - 1, F.transform(places, lambda p: F.get("_grid", p - 1))).otherwise(F.array(F.get("_grid", F.lit(0))))
    return sketched.select(*key, F.array_distinct(taken).alias("_cuts"))


def chunk_of(value: Column, values: Column, most: int) -> Column:
    """How many of the ascending ``values``, ``most`` at most, are smaller: found by halving."""
    place = F.lit(0)
    for step in (1 << n for n in reversed(range(most.bit_length()))):
        # A lambda's argument is worked out once, however often it is named.
        higher = lambda p, step=step: F.when(F.get(values, p + (step - 1)) < value, p + step).otherwise(p)
        place = F.get(F.transform(F.array(place), higher), F.lit(0))
    return place


def add_chunks(df: DataFrame, key: Sequence[str], order: str | Sequence[str], max_rows: int = MAX_ROWS) -> DataFrame:
    """Add ``_chunk`` where some key is heavy; return ``df`` as it is where none is.

    Chunks ascend with ``order`` and hold ``max_rows`` rows of their key at most; only rows alike in all of ``order``
    never part. One count per key is read first (one narrow, pre-aggregated pass); only a heavy key costs more. A
    sketch of its first order column's quantiles gives values to cut at, and each row finds its chunk by halving
    among its key's values: no row is shuffled. An exact count per chunk confirms the bound. A key with a chunk
    above it, as many equal values make, is cut again by the places of its order tuples, as are keys whose first
    order column has no quantiles.
    """
    order = [order] if isinstance(order, str) else list(order)
    if heavy_keys(df, key, max_rows).isEmpty():
        return df
    heavy = stored(heavy_keys(df, key, max_rows), "heavy")
    over, cut = heavy, df.withColumn(CHUNK, F.lit(None).cast("long"))
    if isinstance(df.schema[order[0]].dataType, SKETCHED):
        # A heavy key has more than max_rows rows, so there are at most rows / max_rows of them, and twice as many values.
        found = stored(cuts(_rows_of(df, key, heavy).select(*key, order[0]), key, order[0], heavy, max_rows), "cuts")
        sizes = _cut_by(_rows_of(df, key, heavy), key, order[0], found).groupBy(*key, CHUNK).agg(F.count(F.lit(1)).alias("_rows"))
        over = stored(sizes.where(F.col("_rows") > max_rows).select(*key).distinct(), "over")
        fine = _rows_of(found, key, over, "left_anti")
        if not fine.isEmpty():
            cut = _cut_by(df, key, order[0], stored(fine, "cuts"))
    return cut if over.isEmpty() else _cut_by_places(cut, key, order, over, max_rows)


def _named(names: Sequence[str]) -> tuple[list[Column], list[Column]]:
    """Columns under other names, and the conditions that they equal those of a row, null or not."""
    return [F.col(c).alias(f"_of_{c}") for c in names], [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in names]


def _rows_of(df: DataFrame, key: Sequence[str], keys: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of the listed heavy keys, of which there are at most one for each ``max_rows`` rows."""
    columns, same = _named(key)
    return df.join(F.broadcast(keys.select(*columns)), same, how)


def _cut_by(df: DataFrame, key: Sequence[str], first: str, found: DataFrame) -> DataFrame:
    """Number the chunks of the keys of :func:`cuts`; other rows have none."""
    most = found.agg(F.max(F.size("_cuts"))).first()[0]
    columns, same = _named(key)
    place = F.when(F.col("_cuts").isNotNull(), chunk_of(F.col(first), F.col("_cuts"), most).cast("long"))
    joined = df.join(F.broadcast(found.select(*columns, "_cuts")), same, "left")
    return joined.withColumn(CHUNK, place).drop("_cuts", *[f"_of_{c}" for c in key])


def _cut_by_places(df: DataFrame, key: Sequence[str], order: Sequence[str], over: DataFrame, max_rows: int) -> DataFrame:
    """Cut the listed keys every ``max_rows`` rows of their whole order; rows find their chunk by key and order together."""
    tuples = [*key, *order]
    columns, same = _named(tuples)
    chunk = F.floor((F.col("_rank") - 1) / max_rows).cast("long").alias("_part")
    found = places(_rows_of(df.select(*tuples), key, over), key, order).select(*columns, chunk)
    joined = df.join(found, same, "left").drop(*[f"_of_{c}" for c in tuples])
    return joined.withColumn(CHUNK, F.coalesce("_part", CHUNK)).drop("_part")


def has_chunks(df: DataFrame) -> bool:
    return CHUNK in df.columns


def chunk_window(df: DataFrame, key: Sequence[str], order: Sequence[str | Column]) -> Window:
    """Window over a key's rows in order, per chunk where there are chunks."""
    return Window.partitionBy(*key, *([CHUNK] if has_chunks(df) else [])).orderBy(*order)


def join_chunks(df: DataFrame, per_chunk: DataFrame, key: Sequence[str]) -> DataFrame:
    """Left join of values kept per (key, chunk).

    The chunk side is tiny next to the rows. As the hash side it leaves the rows' partitioning
    and order alone, so all windows over (key, chunk) share one exchange and one sort.
    """
    return df.join(per_chunk.hint("shuffle_hash"), [*key, CHUNK], "left")


def positions(
    df: DataFrame, key: Sequence[str], order: Sequence[str], name: str = "pos",
    max_rows: int | None = MAX_ROWS,
) -> DataFrame:
    """Number the rows of each key from 1 in order, heavy keys in many tasks.

    With ``max_rows`` None no key is known to be heavy, and none is looked for.
    """
    if max_rows is not None and not has_chunks(df):
        df = add_chunks(df, key, order, max_rows)
    local = F.row_number().over(chunk_window(df, key, order))
    if not has_chunks(df):
        return df.withColumn(name, local.cast("long"))
    before = Window.partitionBy(*key).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.where(F.col(CHUNK).isNotNull())
        .groupBy(*key, CHUNK)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*key, CHUNK, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    joined = join_chunks(df, offsets, key)
    return joined.withColumn(name, local + F.coalesce("_before", F.lit(0))).drop("_before", CHUNK)


def paged_arrays(
    df: DataFrame, key: Sequence[str], order: Sequence[str], values: Sequence[str], page_rows: int = 10_000,
    max_rows: int | None = MAX_ROWS,
) -> DataFrame:
    """Ordered arrays per key, nulls kept, in pages of at most ``page_rows`` elements.

    A key of up to ``page_rows`` rows is one row with page 0; the pages of a longer one follow
    each other, so no row outgrows a task and no element is left out.
    """
    chunk = [CHUNK] if has_chunks(df) else []
    rows = df.select(*key, *dict.fromkeys([*order, *values]), *chunk)
    numbered = positions(rows, key, order, "_pos", max_rows)
    page = F.floor((F.col("_pos") - 1) / page_rows).cast("int").alias("page")
    rows = F.array_sort(F.collect_list(F.struct("_pos", *values)))
    return (
        numbered.groupBy(*key, page)
        .agg(rows.alias("_rows"))
        .select(*key, "page", F.size("_rows").alias("n"), *[F.col(f"_rows.{v}").alias(v) for v in values])
    )
