"""Filters, lookups, navigation and changes over keyed tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.operators.ranking import last_wins
from runledger.session import unused

#: Rows of a large join that a task is to hold at most, unless one key has more.
TASK_ROWS = 500_000


def where_eq(df: DataFrame, **equal: object) -> DataFrame:
    """Rows equal in all given columns; None means the column is null."""
    for name, value in equal.items():
        column = F.col(name)
        df = df.where(column.isNull() if value is None else column == F.lit(value))
    return df


def get_one(df: DataFrame, order: Sequence[str], **equal: object) -> DataFrame:
    """First matching row by ``order``, or no row."""
    return where_eq(df, **equal).orderBy(*order).limit(1)


def lookup(df: DataFrame, key: str, by_name: bool = False, id_col: str = "id", name_col: str = "name") -> DataFrame:
    """First row with this id, or with this name."""
    return get_one(df, [id_col], **{name_col if by_name else id_col: key})


def semi(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is listed."""
    return df.join(keys.select(*on), list(on), "left_semi")


def job_tree(
    jobs: DataFrame, iterations: DataFrame, epochs: DataFrame, evals: DataFrame, task_rows: int = TASK_ROWS
) -> DataFrame:
    """Jobs with their steps, and each step with its epochs and evaluation results, a row for each of either.

    A step without any is one row. Epochs and results are rows of one table, so a step that has both has
    as many rows as it has of them. Many rows are dealt to more tasks than the session's number of shuffle partitions, so
    that none holds and sorts much more than ``task_rows`` of them; a count of the rows is read first.
    """
    steps = iterations.select(
        F.col("uuid").alias("iteration_uuid"), F.col("training_job_uuid").alias("job_uuid"), "step_type",
        F.col("iteration_number").alias("step_number"),
    )
    epoch_rows = epochs.select("iteration_uuid", "epoch_number", F.col("uuid").alias("epoch_uuid"))
    eval_rows = evals.select("iteration_uuid", "model_id", "dataset", F.col("uuid").alias("eval_uuid"))
    below = epoch_rows.unionByName(eval_rows, allowMissingColumns=True)
    n = math.ceil(max(below.count(), steps.count()) / task_rows)
    owners = jobs.select(F.col("uuid").alias("job_uuid"), "status")
    known = _dealt(owners, n, "job_uuid").join(_dealt(steps, n, "job_uuid"), "job_uuid")
    return _dealt(known, n, "iteration_uuid").join(_dealt(below, n, "iteration_uuid"), "iteration_uuid", "left")


def _dealt(df: DataFrame, n: int, key: str) -> DataFrame:
    """Rows dealt by ``key`` to ``n`` tasks, where the session's shuffles would use fewer."""
    return df.repartition(n, key) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def entity_counts(**tables: DataFrame) -> DataFrame:
    """Row count per table."""
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("entity"), "n") for name, df in tables.items()]
    result = counts[0]
    for other in counts[1:]:
        result = result.unionByName(other)
    return result


def update_rows(table: DataFrame, changes: DataFrame, key: Sequence[str], seq: str) -> DataFrame:
    """Set the columns the changes bring on existing rows; the last change of a key wins.

    ``changes`` carries the key, ``seq`` and the columns to set; keys not in the table are ignored.
    """
    names = [c for c in changes.columns if c not in (*key, seq)]
    new = unused(table, "_new")
    update = last_wins(changes, key, [seq]).select(*key, F.struct(F.lit(True).alias("hit"), *names).alias(new))
    joined = table.join(update, list(key), "left")
    return joined.select(
        *[F.when(F.col(f"{new}.hit"), F.col(f"{new}.{c}")).otherwise(F.col(c)).alias(c) if c in names else F.col(c)
          for c in table.columns]
    )


def upsert(table: DataFrame, changes: DataFrame, key: Sequence[str], seq: str) -> DataFrame:
    """Replace rows by the last change of their key and add the new ones.

    The table itself is only filtered by the changed keys; it is not ranked or sorted.
    """
    latest = last_wins(changes, key, [seq]).select(*table.columns)
    return delete_rows(table, latest, key).unionByName(latest)


def delete_rows(table: DataFrame, keys: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose key is not listed."""
    return table.join(keys.select(*key), list(key), "left_anti")


def migrate(df: DataFrame, add: dict[str, str] | None = None, drop: Sequence[str] = ()) -> DataFrame:
    """Add columns of the given types, empty, and drop others."""
    return df.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in (add or {}).items()]).drop(*drop)


def layered(base: DataFrame, overrides: DataFrame, on: Sequence[str], base_map: str, override_map: str) -> DataFrame:
    """Map of the base with the override's entries on top, key by key; no override, base alone."""
    over = F.col(override_map)
    kept = F.map_filter(base_map, lambda k, _: ~F.map_contains_key(over, k))
    joined = base.join(overrides, list(on), "left")
    merged = F.when(over.isNull(), F.col(base_map)).otherwise(F.map_concat(kept, over))
    return joined.select(*on, *[c for c in base.columns if c not in (*on, base_map)], merged.alias("config"))


def attached(owners: DataFrame, owner: str, names: str, items: DataFrame, item_name: str) -> DataFrame:
    """Items an owner lists by name; an owner with a null list has none."""
    listed = owners.select(owner, F.explode(F.array_distinct(names)).alias(item_name))
    return items.join(listed, item_name)
