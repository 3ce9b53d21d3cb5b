"""Labelled datasets as CSV with a column mapping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load_dataset(
    spark: SparkSession, path: str, input_col: str, output_cols: Sequence[str], think_col: str | None = None
) -> DataFrame:
    """Input text, outputs and optional reasoning of a CSV with a header, as strings.

    Quoted cells may span lines, so a file is read in one piece by one task; give a large dataset as many files.
    """
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', inferSchema=False)
    think = F.col(think_col) if think_col else F.lit(None).cast("string")
    return raw.select(
        F.col(input_col).alias("input"),
        F.struct(*[F.col(c) for c in output_cols]).alias("outputs"),
        think.alias("think"),
    )
