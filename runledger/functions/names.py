"""Model ids, storage paths and other derived names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name fragments of machine types with an ARM processor.
ARM_NAMES = ("gh200", "grace")
# Folders of stored files and of files on the machine of a run.
PROJECTS, MEDIA, DATA, CONFIG = "media/projects/", "media/", "data/", "/config.yaml"


def model_id(iteration: Column, epoch: Column) -> Column:
    """``iteration_{n}_epoch_{e}``; a null number is spelt None, an unknown epoch is empty."""
    number = F.coalesce(iteration.cast("string"), F.lit("None"))
    return F.concat(F.lit("iteration_"), number, F.lit("_epoch_"), F.coalesce(epoch.cast("string"), F.lit("")))


def _int_part(text: Column, index: int) -> Column:
    return F.get(F.split(text, "_"), index).try_cast("int")


def model_iteration(model: Column) -> Column:
    """Iteration number in a model id, null if there is none."""
    return _int_part(model, 1)


def model_epoch(model: Column) -> Column:
    """Epoch in a model id of four or more parts whose third is ``epoch``."""
    parts = F.split(model, "_")
    return F.when((F.size(parts) >= 4) & (F.get(parts, 2) == "epoch"), _int_part(model, 3))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]*$", 0)


def file_path() -> Column:
    """Path of the file that a row was read from, as the file is named; Spark's metadata has it as a URI."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def run_prefix(project_id: Column, run_id: Column) -> Column:
    """Storage folder of a run."""
    return F.concat(F.lit(PROJECTS), project_id, F.lit("/"), run_id)


def config_path(project_id: Column, run_id: Column) -> Column:
    return F.concat(run_prefix(project_id, run_id), F.lit(CONFIG))


def media_path(file_name: Column) -> Column:
    return F.concat(F.lit(MEDIA), F.coalesce(file_name, F.lit("")))


def data_path(file_name: Column) -> Column:
    return F.concat(F.lit(DATA), basename(media_path(file_name)))


def gpu_arch(name: Column) -> Column:
    """``ARM`` or ``x86`` by the machine type's name."""
    arm = F.lit(False)
    for fragment in ARM_NAMES:
        arm = arm | F.contains(F.lower(name), F.lit(fragment))
    return F.when(arm, "ARM").otherwise("x86")


def first_region(regions: Column) -> Column:
    return F.get(regions, 0)["name"]


def percent(done: Column, total: Column) -> Column:
    """Share done in percent; null for a total of zero."""
    return F.try_divide(done * F.lit(100.0), total)
