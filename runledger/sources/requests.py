"""Training requests: one JSON document per file, or per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.functions.names import file_path


def read_requests(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Request files with a sound envelope: ``(file, stem, document)``.

    The envelope is sound if ``success`` is truthy and ``data`` is there. Files order by name
    (``file``); each document is read whole.
    """
    raw = spark.read.text(path, wholetext=True).select(
        file_path().alias("file"),
        F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1).alias("stem"),
        F.try_parse_json("value").alias("document"),
    )
    return raw.where(sound_envelope(F.col("document")))


def sound_envelope(document: Column) -> Column:
    success = F.try_variant_get(document, "$.success", "boolean")
    return F.coalesce(success, F.lit(False)) & F.try_variant_get(document, "$.data", "variant").isNotNull()


def unwrap_request(document: Column) -> Column:
    """The request inside an envelope, or the document itself where it has none."""
    return F.coalesce(F.try_variant_get(document, "$.data.request_data", "variant"), document)
