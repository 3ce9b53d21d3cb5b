"""Entity tables in the session catalog or in folders."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from runledger.schemas import TABLES


def create_tables(spark: SparkSession, database: str = "default") -> list[str]:
    """Create the entity tables that do not exist yet."""
    for name, schema in TABLES.items():
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        spark.sql(f"CREATE TABLE IF NOT EXISTS `{database}`.`{name}` ({columns}) USING parquet")
    return list_tables(spark, database)


def drop_tables(spark: SparkSession, database: str = "default") -> None:
    for name in TABLES:
        spark.sql(f"DROP TABLE IF EXISTS `{database}`.`{name}`")


def list_tables(spark: SparkSession, database: str = "default") -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables(database) if not t.isTemporary)


def _counted(df: DataFrame) -> tuple[DataFrame, Observation]:
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def append(df: DataFrame, table: str) -> int:
    """Append to a catalog table by column name; return the rows written, counted on the way."""
    names = [f.name for f in df.sparkSession.table(table).schema]
    counted, seen = _counted(df.select(*names))
    counted.write.insertInto(table)
    return seen.get["rows"]


def write_folder(
    df: DataFrame, path: str, mode: str = "errorifexists", partition_by: Sequence[str] = (), fmt: str = "parquet"
) -> int:
    """Write a folder of files and return the rows written.

    With ``mode="overwrite"`` and partitions only the partitions that occur are replaced.
    """
    counted, seen = _counted(df)
    writer = counted.write.mode(mode).format(fmt).option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*partition_by).save(path)
    return seen.get["rows"]


def change_table(
    spark: SparkSession, table: str, part: str, keys: DataFrame, key: Sequence[str], change: Callable[[DataFrame], DataFrame],
    moves: bool = True,
) -> int:
    """Change a table partitioned by ``part`` where it has, or is to have, rows of ``keys``; return the rows written.

    ``keys`` are the changed keys, with ``part`` where a change adds or moves rows; a null key matches none, and rows that
    end up in a partition that ``keys`` do not tell are an error.
    ``change`` gets the rows of the partitions concerned. Its result is written to a new folder, and when all of it
    is there each partition is pointed at its own share; others are neither read in full nor touched, and no
    session setting matters. A partition that ends up empty is dropped. Null is a partition like any other,
    and an empty text is null, as in any partition that Spark writes. A failure leaves every partition whole,
    as before or as changed; the change made again by key completes it. Folders of earlier contents stay
    for readers that have begun, until :func:`remove_unused`. With ``moves`` False a key has its rows in the
    partition that ``keys`` say and in no other, so the table is not looked through for them.
    """
    rows = spark.table(table)
    names = [c for c in rows.columns if c != part]
    kind = rows.schema[part].dataType
    value = F.col(part).cast(kind)
    value = (F.nullif(value, F.lit("")) if isinstance(kind, StringType) else value).alias("value")
    text = F.col("value").cast("string").alias("text")
    concerned = keys.select(value) if part in keys.columns else None
    if moves:
        found = rows.select(*key, part).join(keys.select(*key), list(key), "left_semi").select(value)
        concerned = concerned.union(found) if concerned else found
    wanted = {r.text: r.value for r in concerned.distinct().select("value", text).collect()}  # a row for each partition
    held = F.coalesce(F.col(part).isin([v for v in wanted.values() if v is not None]), F.lit(None in wanted))
    changed = change(rows.where(held).select(*rows.columns)).select(F.struct(*names).alias("row"), value)
    version = uuid.uuid4().hex
    folder, slot = f"{location(spark, table).rstrip('/')}/_{version}", f"slot_{version}"
    # Each partition's rows in a folder by its own number, whatever characters its value has.
    schema = StructType([StructField("of", kind), StructField(slot, IntegerType())])
    numbered = spark.createDataFrame([(v, n) for n, v in enumerate(wanted.values())], schema)
    placed = changed.join(numbered, F.col("value").eqNullSafe(F.col("of")), "left").select("row.*", F.coalesce(slot, F.lit(-1)).alias(slot))
    placed.hint("rebalance", slot).write.partitionBy(slot).parquet(folder)
    written = StructType([*[f for f in rows.schema if f.name != part], StructField(slot, IntegerType())])
    found = {r[0]: r[1] for r in spark.read.schema(written).parquet(folder).groupBy(slot).count().collect()}
    if -1 in found:
        raise ValueError(f"{found[-1]} rows are in partitions that the keys do not tell")
    for n, text_ in enumerate(wanted):
        spec = f"PARTITION (`{part}` = {_literal(text_)})"
        if n in found:
            spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS {spec} LOCATION '{folder}/{slot}={n}'")
            spark.sql(f"ALTER TABLE {table} {spec} SET LOCATION '{folder}/{slot}={n}'")
    for n, text_ in enumerate(wanted):
        if n not in found:
            spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION (`{part}` = {_literal(text_)})")
    spark.catalog.refreshTable(table)
    return sum(found.values())


def _literal(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def remove_unused(spark: SparkSession, table: str) -> int:
    """Delete the folders below a table that earlier changes have left and no partition points at; return their number.

    For times when nobody reads or changes the table.
    """
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(location(spark, table))
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = F.regexp_extract(F.col("_metadata.file_path"), r"/(_[0-9a-f]{32}/slot_[0-9a-f]{32}=\d+)/[^/]*$", 1)
    used = {r[0] for r in spark.table(table).select(names).distinct().collect()}
    removed = 0
    for version in files.listStatus(root):
        name = version.getPath().getName()
        if re.fullmatch("_[0-9a-f]{32}", name):
            for slot in files.listStatus(version.getPath()):
                if f"{name}/{slot.getPath().getName()}" not in used:
                    removed += files.delete(slot.getPath(), True)
    return removed


def location(spark: SparkSession, table: str) -> str:
    """The folder of a catalog table."""
    return spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where("col_name = 'Location'").first().data_type


def sql(spark: SparkSession, text: str, args: Mapping[str, object] | None = None, **views: DataFrame) -> DataFrame:
    """Run SQL with named parameters; DataFrames given by keyword can be named in it in braces."""
    return spark.sql(text, args=dict(args or {}), **views)


def read_jdbc(spark: SparkSession, url: str, table: str, split_column: str, lower: str, upper: str, parts: int) -> DataFrame:
    """A table of an external database, read in parallel by ranges of a column."""
    return spark.read.jdbc(url, table, column=split_column, lowerBound=lower, upperBound=upper, numPartitions=parts)
