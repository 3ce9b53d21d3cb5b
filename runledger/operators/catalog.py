"""Choosing a machine from a catalog ``(name, regions, price_cents, gpus)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.functions.names import first_region, gpu_arch


def eligible_instances(catalog: DataFrame, gpus: int | None = None) -> DataFrame:
    """x86 types with capacity somewhere, and with exactly ``gpus`` devices if given."""
    found = catalog.where((F.size("regions") > 0) & (gpu_arch(F.col("name")) == "x86"))
    return found if gpus is None else found.where(F.col("gpus") == gpus)


def cheapest(catalog: DataFrame, position: str, gpus: int | None = None) -> DataFrame:
    """Cheapest eligible type, the first by catalog position among equals, in its first region."""
    return (
        eligible_instances(catalog, gpus)
        .orderBy("price_cents", position)
        .limit(1)
        .select("name", first_region(F.col("regions")).alias("region"))
    )
