"""Running registers: the value set or cleared last before each row of a key.

A register is a window expression. Later passes may guard on registers of earlier ones; all
passes use one partitioning and one order, so Spark plans one exchange and one sort for them.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.operators.chunks import CHUNK, MAX_ROWS, add_chunks, chunk_window, has_chunks, join_chunks
from runledger.session import stored


@dataclass(frozen=True)
class Register:
    """Set to ``value`` where ``set_if`` holds, to null where ``clear_if`` holds.

    The change is wrapped in a struct: a clear, or a null value, is a change all the same.
    """

    set_if: Column
    value: Column
    clear_if: Column | None = None

    def change(self) -> Column:
        wrapped = F.struct(self.value.alias("v"))
        change = F.when(F.coalesce(self.set_if, F.lit(False)), wrapped)
        if self.clear_if is None:
            return change
        empty = F.struct(F.when(F.lit(False), self.value).alias("v"))
        return change.when(F.coalesce(self.clear_if, F.lit(False)), empty)


RegisterPass = Callable[[DataFrame], Mapping[str, Register]]


def last_changes(df: DataFrame, group: Sequence[str], order: Sequence[str], registers: Mapping[str, Register]) -> DataFrame:
    """The last change of every register per group, null where it never changed."""
    at = F.struct(*order)
    return df.groupBy(*group).agg(
        *[
            F.max_by(reg.change(), F.when(reg.change().isNotNull(), at)).alias(name)
            for name, reg in registers.items()
        ]
    )


def _chunk_carry(df: DataFrame, key: Sequence[str], order: Sequence[str], registers: Mapping[str, Register]) -> DataFrame:
    """Change in force when each chunk begins, from the chunks before it: one row per chunk.

    Stored, it spares later passes from working out the earlier ones again.
    """
    before = Window.partitionBy(*key).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    ends = last_changes(df.where(F.col(CHUNK).isNotNull()), [*key, CHUNK], order, registers)
    return ends.select(
        *key, CHUNK, *[F.last(name, ignorenulls=True).over(before).alias(f"_carry_{name}") for name in registers]
    )


def _with_initial(df: DataFrame, key: Sequence[str], initial: DataFrame) -> DataFrame:
    """Add what the registers start from to every row.

    It is joined to the groups of rows, one row per key or chunk, and to the rows by these.
    """
    names = [c for c in initial.columns if c not in key]
    start = initial.select(*key, *[F.col(c).alias(f"_initial_{c}") for c in names])
    if not has_chunks(df):
        return df.join(start, list(key), "left")
    groups = df.select(*key, CHUNK).distinct().join(start, list(key)).select(
        *[F.col(c).alias(f"_of_{c}") for c in (*key, CHUNK)], *[f"_initial_{c}" for c in names]
    )
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in (*key, CHUNK)]
    return df.join(groups, same, "left").drop(*[f"_of_{c}" for c in (*key, CHUNK)])


def with_registers(
    df: DataFrame,
    passes: Sequence[RegisterPass],
    key: Sequence[str],
    order: Sequence[str],
    initial: DataFrame | None = None,
    max_rows: int | None = MAX_ROWS,
) -> DataFrame:
    """Add each register's value before the row, one column per register.

    ``df`` may bring its own ``_chunk`` (null or ascending with ``order``); otherwise heavy keys
    are cut here, unless ``max_rows`` is None: then no key is known to be heavy. ``initial`` holds one row per key with the value a register starts from, as a
    struct ``v`` under the register's name (null where it never changed).
    """
    if max_rows is not None and not has_chunks(df):
        df = add_chunks(df, key, order, max_rows)
    if initial is not None:
        df = _with_initial(df, key, initial)
    for make in passes:
        registers = make(df)
        if has_chunks(df):
            df = join_chunks(df, stored(_chunk_carry(df, key, order, registers), "carry"), key)
        window = chunk_window(df, key, order).rowsBetween(Window.unboundedPreceding, -1)
        columns = {}
        for name, reg in registers.items():
            held = [F.last(reg.change(), ignorenulls=True).over(window)]
            held += [F.col(f"{p}{name}") for p in ("_carry_", "_initial_") if f"{p}{name}" in df.columns]
            columns[name] = F.coalesce(*held)["v"]
        df = df.select("*", *[value.alias(name) for name, value in columns.items()])
        df = df.drop(*[c for c in df.columns if c.startswith("_carry_")])
    return df.drop(*[c for c in df.columns if c.startswith("_initial_")])
