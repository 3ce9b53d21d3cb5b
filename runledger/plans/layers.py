"""Settings from any number of layers of documents, each with the layer that it comes from.

A layer is a folder of JSON documents, one object a file; what a document says goes over what the layers before
say, name by name. A target has a document of its own in each layer, or none.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Mapping
from functools import partial
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.functions.names import file_path
from runledger.session import setting, stored

#: Bytes that opening a document counts for when files are dealt to tasks: Spark's own 4 MB would make a task of 32 of them.
OPEN_COST = 64 << 10
#: Documents of a batch that a task lists or reads.
BATCH = 1000


def _names(system: fs.FileSystem, folder: str) -> Iterator[str]:
    """Names of the JSON files in a folder, one after the other where the file system can do that; hidden ones are left out as Spark does."""
    if isinstance(system, fs.LocalFileSystem):
        with os.scandir(folder) as entries:
            yield from (e.name for e in entries if _is_document(e.name) and e.is_file())
    else:
        found = system.get_file_info(fs.FileSelector(folder))
        yield from (f.base_name for f in found if f.is_file and _is_document(f.base_name))


def _is_document(name: str) -> bool:
    return name.endswith(".json") and not name.startswith(".") and not (name.startswith("_") and "=" not in name)


def _batches(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    while part := list(islice(rows, BATCH)):
        yield pa.record_batch([pa.array(values, kind) for values, kind in zip(zip(*part), kinds)], names)


def _listed(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``layer, name`` of the files in each layer's folder."""
    system, root = fs.FileSystem.from_uri(path)
    for batch in batches:
        for layer in batch.column("layer").to_pylist():
            yield from _batches(((layer, n) for n in _names(system, f"{root}/{layer}")), ["layer", "name"], [pa.string()] * 2)


def _read(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with their bytes: ``layer, name, value``."""
    system, root = fs.FileSystem.from_uri(path)

    def content(layer: str, name: str) -> bytes:
        with system.open_input_stream(f"{root}/{layer}/{name}", compression=None) as handle:
            return handle.read()

    files = ((r["layer"], r["name"]) for batch in batches for r in batch.to_pylist())
    told = ((layer, name.removesuffix(".json"), content(layer, name)) for layer, name in files)
    yield from _batches(told, ["layer", "name", "value"], [pa.string(), pa.string(), pa.binary()])


def _documents(spark: SparkSession, path: str) -> DataFrame:
    """``layer, name, value`` of the documents. Tasks list the folders and read the files, so the driver knows folders only."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        fs.FileSystem.from_uri(path)
    except (pa.ArrowException, OSError, ValueError):
        return _by_spark(spark, path, system.makeQualified(folder).depth() + 2)
    layers = [(s.getPath().getName(),) for s in system.listStatus(folder) if s.isDirectory()]
    folders = spark.createDataFrame(layers, "layer string").repartition(max(1, len(layers)))
    names = folders.mapInArrow(partial(_listed, path), "layer string, name string")
    dealt = names.repartition(2 * spark.sparkContext.defaultParallelism, "layer", "name")
    read = dealt.mapInArrow(partial(_read, path), "layer string, name string, value binary")
    return read.withColumn("value", F.col("value").cast("string"))


def _by_spark(spark: SparkSession, path: str, deep: int) -> DataFrame:
    """The same through Spark's reader, for file systems that only Spark can open; it lists all files in the driver."""
    found = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(f"{path}/*")
    # Only files in the layers' own folders are documents.
    steps = F.size(F.split(F.regexp_replace(file_path(), "^[^:/]+:(//[^/]*)?", ""), "/")) - 1
    return found.where(steps == deep).select(
        F.regexp_extract(file_path(), "([^/]+)/[^/]+$", 1).alias("layer"),
        F.regexp_extract(file_path(), "([^/]+)[.]json$", 1).alias("name"), "value",
    )


def read_layers(spark: SparkSession, path: str) -> DataFrame:
    """``layer, name, setting, value`` of the documents ``<path>/<layer>/<name>.json``.

    Values are texts, those that are no string as JSON; a setting given as null has a null value, but is there. A file
    that is no JSON object has no settings, of a name given twice the last value counts. Each layer's folder is listed
    by one task, name by name on a local disk; many small files are read by one task, and what they say is stored.
    """
    files = _documents(spark, path).select("layer", "name", F.try_parse_json("value").alias("document"))
    objects = files.where(F.schema_of_variant("document").startswith("OBJECT"))
    objects.createOrReplaceTempView("layer_documents")
    told = F.schema_of_variant(F.col("value"))
    value = F.when(told != "VOID", F.when(told == "STRING", F.variant_get("value", "$", "string")).otherwise(F.to_json("value")))
    try:
        entries = spark.sql("SELECT layer, name, key, value FROM layer_documents, LATERAL variant_explode(document)")
    finally:
        spark.catalog.dropTempView("layer_documents")
    with setting(spark, "spark.sql.files.openCostInBytes", str(OPEN_COST)):
        return stored(entries.select("layer", "name", F.col("key").alias("setting"), value.alias("value")), "settings")


def folded_settings(targets: DataFrame, key: str, layers: Mapping[str, Column], documents: DataFrame) -> DataFrame:
    """``key, setting, value, origin``: each target's settings and the layer that had the last word on it.

    ``layers`` says, in their order, which document of each layer a target takes: an expression over the target's
    columns, null for none. A name without a document adds nothing. ``key`` names one target each.
    """
    takes = F.array(*[
        F.struct(F.lit(place).alias("place"), F.lit(layer).alias("layer"), name.cast("string").alias("name"))
        for place, (layer, name) in enumerate(layers.items())
    ])
    wanted = targets.select(F.col(key).alias("target"), F.inline(takes)).where(F.col("name").isNotNull())
    said = wanted.join(documents, ["layer", "name"])
    last = F.max_by(F.struct("value", "layer"), "place").alias("last")
    return said.groupBy("target", "setting").agg(last).select(
        F.col("target").alias(key), "setting", "last.value", F.col("last.layer").alias("origin")
    )
