"""Object listings and what to copy from where to where."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Files every run is given, as (kind, source column, target column, whole folder).
TRANSFERS = (
    ("train dataset", "train_s3_path", "train_file_path", False),
    ("eval dataset", "eval_s3_path", "eval_file_path", False),
    ("config", "config_s3_path", "config_file_path", False),
    ("training images", "train_image_root_s3_path", "train_image_root_path", True),
    ("evaluation images", "eval_image_root_s3_path", "eval_image_root_path", True),
)
# Fixed value: logs are not published.
LOGS = r"\.log$"
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"


def list_objects(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """Objects below a folder whose relative name begins with ``prefix``; no content is read.

    Names are as stored. Spark's listing leaves out files whose name begins with ``_`` or ``.``.
    """
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    # The scheme and host come and go with the file system; what follows them begins with the root once.
    full = F.regexp_replace("path", SCHEME, "")
    root = re.sub("/+", "/", re.sub(SCHEME, "", path)).rstrip("/") + "/"
    name = F.substring(full, F.lit(len(root) + 1), F.length(full))
    return listing.select(
        name.alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("last_modified")
    ).where(F.startswith("name", F.lit(prefix)) & ~F.endswith("name", F.lit("/")))


def sync_plan(source: DataFrame, target: DataFrame, exclude: str = LOGS) -> DataFrame:
    """Objects ``(name, size)`` missing from the target or there with another size."""
    wanted = source.where(~F.col("name").rlike(exclude))
    return wanted.join(target.select("name", "size"), ["name", "size"], "left_anti")


def transfer_plan(configs: DataFrame, job: str) -> DataFrame:
    """One row per file or folder a job needs: ``(job, kind, source, target, recursive)``."""

    def entry(kind: str, source: str, target: str, recursive: bool) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"),
            F.col(source).alias("source"),
            F.col(target).alias("target"),
            F.lit(recursive).alias("recursive"),
        )

    plan = configs.select(job, F.explode(F.array(*[entry(*t) for t in TRANSFERS])).alias("t")).select(job, "t.*")
    return plan.where(F.col("source").isNotNull() & F.col("target").isNotNull())
