"""Run configurations from requests and layered defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.functions.names import basename, config_path, data_path, media_path, run_prefix
from runledger.functions.payload import is_present, json_default, text_at
from runledger.operators.tables import layered
from runledger.session import compute_once, setting

_R1_DISTILL = "deepseek-ai/DeepSeek-R1-Distill-Qwen-1.5B"
_QWEN_2B = "Qwen/Qwen2-VL-2B-Instruct"
_QWEN_7B = "Qwen/Qwen2-VL-7B-Instruct"

# The settings of all tasks, and what each task type sets on top.
DEFAULTS = {
    "trajectory_name": "run_1",
    "training_name": "run_1",
    "trajectory_count": "2",
    "ref_model_name": _R1_DISTILL,
    "model_name": _R1_DISTILL,
    "max_new_tokens": "2",
    "reward": "classify_text",
    "model_epoch": "1",
    "start_iteration": "1",
    "topk": "1",
    "topk_eval": "1",
    "save_every_epoch": "1",
    "accumulation_steps": "1",
    "no_epochs": "1",
    "no_iterations": "2",
    "loss": "grpo",
}
_TASK = {**DEFAULTS, "trajectory_count": "10", "max_new_tokens": "250"}
TASKS = {
    "text_classification": {**_TASK, "reward": "text_classification", "topk_trajectory": "50"},
    "entity_extraction": {**_TASK, "reward": "entity_extraction"},
    "image_classification": {
        **_TASK, "reward": "image_classification", "topk_trajectory": "50", "ref_model_name": _QWEN_7B,
        "model_name": _QWEN_2B, "start_iteration": "3",
    },
    "image_extraction": {
        **_TASK, "reward": "image_extraction", "topk_trajectory": "50", "ref_model_name": _QWEN_7B,
        "model_name": _QWEN_7B, "start_iteration": "2",
    },
}
# Settings a run takes from its task, and what they are where no layer sets them.
SETTINGS = {
    "reward": "classify_text",
    "reward_params": "{}",
    "ref_model_name": _R1_DISTILL,
    "ref_model_params": "{}",
    "model_name": _R1_DISTILL,
    "max_new_tokens": "250",
    "model_params": "{}",
    "trajectory_name": "run_1",
    "trajectory_count": "2",
    "trajectory_params": "{}",
    "start_iteration": "1",
    "topk": "1",
    "save_every_epoch": "1",
    "accumulation_steps": "1",
    "no_epochs": "1",
    "no_iterations": "2",
    "loss": "gspo",
    "model_epoch": "1",
    "topk_eval": "1",
}
NUMBERS = (
    "max_new_tokens", "trajectory_count", "start_iteration", "topk", "save_every_epoch", "accumulation_steps",
    "no_epochs", "no_iterations", "model_epoch", "topk_eval",
)
# Blocks a request must have, in the order they are looked at.
BLOCKS = ("project", "prompt", "train_dataset", "eval_dataset")
FAILING = "Invalid data: '{}' key is missing or empty"
DEFAULT_TASK = "text_classification"
#: Files that a task writing configurations keeps open, one for a task type.
WRITERS = 32


def _map(entries: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(part) for pair in entries.items() for part in pair])


def defaults_table(spark: SparkSession, defaults: dict[str, str] = DEFAULTS) -> DataFrame:
    return spark.range(1).select(_map(defaults).alias("defaults"))


def tasks_table(spark: SparkSession, tasks: dict[str, dict[str, str]] = TASKS) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(t).alias("task_type"), _map(m).alias("settings")) for t, m in tasks.items()])
    return spark.range(1).select(F.explode(rows).alias("t")).select("t.*")


def task_configs(rows: DataFrame, defaults: dict[str, str] = DEFAULTS, tasks: dict[str, dict[str, str]] = TASKS) -> DataFrame:
    """Rows ``(task_type, …)`` with the merged settings ``config``; an unknown type has the defaults.

    The layer table has one row per task type, so its size is known and it is broadcast.
    """
    layers = F.broadcast(tasks_table(rows.sparkSession, tasks))
    return layered(rows.withColumn("_defaults", _map(defaults)), layers, ["task_type"], "_defaults", "settings")


def failing_block(request: Column) -> Column:
    """First required block that is missing or empty, null for a sound request."""
    failing = F.lit(None).cast("string")
    for block in reversed(BLOCKS):
        text = text_at(request, f"$.{block}")
        empty = text.isNull() | text.isin("", "{}", "[]", "0", "false")
        failing = F.when(empty, F.lit(FAILING.format(block))).otherwise(failing)
    return failing


def validate_requests(requests: DataFrame, request: str = "request") -> tuple[DataFrame, DataFrame]:
    """Sound requests, and the others with the ``reason``."""
    checked = compute_once(requests, reason=failing_block(F.col(request)))
    return checked.where(F.col("reason").isNull()).drop("reason"), checked.where(F.col("reason").isNotNull())


def _dataset(request: Column, block: str) -> dict[str, Column]:
    """Columns of one dataset block under the prefix ``train`` or ``eval``."""
    side = block.split("_")[0]
    at = f"$.{block}"
    file_name, image_root = json_default(request, f"{at}.file_name", ""), json_default(request, f"{at}.image_root", "")
    media = media_path(F.coalesce(file_name, F.lit("None")))
    has_images = F.coalesce(image_root, F.lit("")) != ""
    return {
        f"{side}_dataset_id": json_default(request, f"{at}.id", ""),
        f"{side}_s3_path": media,
        f"{side}_file_name": basename(media),
        f"{side}_file_path": data_path(F.coalesce(file_name, F.lit("None"))),
        f"{side}_input_col": json_default(request, f"{at}.input_col", ""),
        f"{side}_output_cols": json_default(request, f"{at}.output_cols", "[]"),
        f"{side}_think_col": json_default(request, f"{at}.think_col", ""),
        f"{side}_image_root_s3_path": F.when(has_images, media_path(image_root)),
        f"{side}_image_root_path": F.when(has_images, F.lit(f"data/{side}_images")),
        f"{side}_image_root": image_root,
    }


def derive_config(
    requests: DataFrame, key: list[str], request: str = "request", defaults: dict[str, str] = DEFAULTS,
    tasks: dict[str, dict[str, str]] = TASKS,
) -> DataFrame:
    """Flat run configuration per sound request; columns a run does not have are null."""
    r = F.col(request)

    def spelt(value: Column) -> Column:
        return F.coalesce(value, F.lit("None"))

    project_id, run_id = json_default(r, "$.project.id", ""), json_default(r, "$.training_run_id", "")
    run = spelt(project_id), spelt(run_id)
    think = F.when(is_present(r, "$.prompt.think_flag"), F.try_variant_get(r, "$.prompt.think_flag", "boolean"))
    columns = {
        "project_name": json_default(r, "$.project.name", ""),
        "project_id": project_id,
        "project_description": json_default(r, "$.project.description", ""),
        "task_type": json_default(r, "$.project.task_type", DEFAULT_TASK),
        "training_run_id": run_id,
        "training_s3_path": run_prefix(*run),
        "config_s3_path": config_path(*run),
        "config_file_path": F.lit("projects_yaml/config.yaml"),
        "prompt_id": json_default(r, "$.prompt.id", ""),
        "prompt_name": json_default(r, "$.prompt.name", ""),
        "system_prompt": json_default(r, "$.prompt.content", ""),
        "think_flag": think.when(~is_present(r, "$.prompt.think_flag"), F.lit(True)),
        "seed_text": json_default(r, "$.prompt.seed_text", ""),
        **_dataset(r, "train_dataset"),
        **_dataset(r, "eval_dataset"),
    }
    flat = requests.select(*key, *[value.alias(name) for name, value in columns.items()])
    merged = task_configs(flat, defaults, tasks)

    def setting(name: str, fallback: str) -> Column:
        value = F.coalesce(F.try_element_at("config", F.lit(name)), F.lit(fallback))
        return (value.try_cast("int") if name in NUMBERS else value).alias(name)

    return merged.select(*key, *columns, *[setting(n, f) for n, f in SETTINGS.items()])


def write_configs(configs: DataFrame, stem: str, path: str) -> None:
    """One JSON document per configuration, in a folder per task type, named by task and request.

    A task keeps a file open for each of up to ``WRITERS`` task types, so that it need not hold and sort its rows by
    type; only rows of further types are sorted.
    """
    fields = [c for c in configs.columns if c != stem]
    documents = configs.select(
        F.col("task_type"),
        F.concat(F.col("task_type"), F.lit("_"), F.col(stem)).alias("name"),
        F.to_json(F.struct(*fields)).alias("config"),
    )
    with setting(configs.sparkSession, "spark.sql.maxConcurrentOutputFileWriters", str(WRITERS)):
        documents.write.mode("errorifexists").partitionBy("task_type").json(path)
