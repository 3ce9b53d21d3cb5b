"""Edge cases that the given tables do not hold."""

import math
import re

import pytest
from pyspark.sql import functions as F

from runledger.functions.names import first_region, gpu_arch, model_epoch, model_id, model_iteration, percent
from runledger.functions.payload import parse_strict, reward_pct, valid_epoch
from runledger.functions.times import minutes_between, or_minutes, parse_local_ts, span_minutes, valid_minutes
from runledger.operators.best import iteration_metrics, job_metrics, update_iterations, update_jobs
from runledger.operators.catalog import cheapest
from runledger.operators.chunks import CHUNK, add_chunks, paged_arrays
from runledger.operators.ranking import argmax_first, first_rows, last_wins, tail_rows
from runledger.operators.tables import attached, get_one, layered, update_rows, where_eq
from runledger.plans.config import derive_config, task_configs, validate_requests
from runledger.plans.jobs import apply_transitions
from runledger.plans.reports import accuracy_report, eval_file_paths, job_time
from runledger.sources.store import append, create_tables, drop_tables, list_tables


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_minutes(spark):
    df = spark.sql("""
        SELECT * FROM VALUES
          ('NaN', timestamp_ntz'2026-01-01 00:00:00', timestamp_ntz'2026-01-01 00:02:00'),
          ('0', timestamp_ntz'2026-01-01 00:00:00', timestamp_ntz'2026-01-01 00:02:00'),
          ('-1', timestamp_ntz'2026-01-01 00:03:00', timestamp_ntz'2026-01-01 00:02:00'),
          ('1440.5', timestamp_ntz'2026-01-01 00:00:00', NULL),
          (NULL, timestamp_ntz'2026-01-01 00:00:00', timestamp_ntz'2026-01-01 00:00:30') AS t(raw, a, b)""")
    a, b, raw = F.col("a"), F.col("b"), F.col("raw")
    rows = values(df, valid_minutes(raw, a, b), or_minutes(raw, a, b), minutes_between(a, b), span_minutes(a, b))
    assert math.isnan(rows[0][0]) and math.isnan(rows[0][1])
    assert rows[1] == (0.0, 2.0, 2.0, 2.0)
    assert rows[2] == (0.0, -1.0, -1.0, 0.0)
    assert rows[3] == (0.0, 1440.5, None, 0.0)
    assert rows[4] == (0.5, 0.5, 0.5, 0.5)


def test_local_times(spark):
    df = spark.createDataFrame([("2026-1-2 3:4:5",), ("2026-01-02T03:04:05",), ("2026-13-02 03:04:05",), (None,)], "t string")
    assert [str(r[0]) for r in values(df, parse_local_ts(F.col("t")))] == ["2026-01-02 03:04:05", "None", "None", "None"]


def test_names(spark):
    df = spark.createDataFrame([("iteration_3_epoch_2",), ("iteration_x_epoch_",), ("a_1_step_2",), ("a",)], "m string")
    assert values(df, model_iteration(F.col("m")), model_epoch(F.col("m"))) == [(3, 2), (None, None), (1, None), (None, None)]
    one = spark.range(1)
    assert values(one, model_id(F.lit(None).cast("int"), F.lit("7")))[0][0] == "iteration_None_epoch_7"
    assert values(one, gpu_arch(F.lit("gpu_1x_GH200")), gpu_arch(F.lit("gpu_8x_a100"))) == [("ARM", "x86")]
    assert values(one, percent(F.lit(1), F.lit(0)), percent(F.lit(1), F.lit(4))) == [(None, 25.0)]


def test_payload(spark):
    df = spark.createDataFrame([('{"a":1}',), ('{"a":1} x',), ('{"a":1},{"a":2}',), ("[1]",), ("",)], "t string")
    assert [r[0] for r in values(df, parse_strict(F.col("t")).isNotNull())] == [True, False, False, True, False]
    df = spark.createDataFrame([("2.9", False), ("2.9", True), ("2", True), ("0", False), ("x", True)], "t string, q boolean")
    assert [r[0] for r in values(df, valid_epoch(F.col("t"), F.col("q")))] == [2, None, 2, None, None]
    df = spark.createDataFrame([('{"answer_reward":{"percentage":0.5}}',), ("{}",)], "m string")
    assert values(df, reward_pct(F.col("m"))) == [(0.5,), (None,)]


def test_foreign_columns_keep_their_names_and_values(spark):
    rows = spark.createDataFrame([(1, 5, "r", "n", "h"), (1, 6, "r", "n", "h"), (2, 7, "r", "n", "h")], "k int, v int, _rank string, _new string, _hit string")
    assert sorted(map(tuple, last_wins(rows, ["k"], ["v"]).collect())) == [(1, 6, "r", "n", "h"), (2, 7, "r", "n", "h")]
    changes = spark.createDataFrame([(1, 50, 1), (1, 51, 2)], "k int, v int, seq int")
    got = update_rows(rows, changes, ["k"], "seq")
    assert got.columns == rows.columns
    assert sorted(map(tuple, got.collect())) == [(1, 51, "r", "n", "h")] * 2 + [(2, 7, "r", "n", "h")]
    assert sorted(r.v for r in tail_rows(rows, ["k"], ["v"], 2000).collect()) == [5, 6, 7]


@pytest.mark.parametrize("kind", ["long", "double", "date", "timestamp", "string"])
def test_chunks_by_any_order_column(spark, kind):
    value = {"date": "date_add(DATE'2024-01-01', CAST(id AS INT))", "timestamp": "timestamp_seconds(id * 3600)", "string": "lpad(CAST(id AS STRING), 6, '0')"}
    rows = spark.range(900).selectExpr("CASE WHEN id < 600 THEN 'hot' WHEN id < 620 THEN 'light' END AS k", f"{value.get(kind, f'CAST(id AS {kind})')} AS v")
    rows = rows.unionByName(spark.createDataFrame([("hot", None)], f"k string, v {kind}"))
    cut = add_chunks(rows, ["k"], "v", 50)
    sizes = cut.where(f"{CHUNK} IS NOT NULL").groupBy("k", CHUNK).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    sizes = sizes.orderBy("k", CHUNK).collect()
    assert {r.k for r in sizes} == {"hot", None} and sum(r.n for r in sizes) == 881 and max(r.n for r in sizes) <= 50
    for k in ("hot", None):
        own = [r for r in sizes if r.k == k and r.low is not None]
        assert all(x.high < y.low for x, y in zip(own, own[1:]))


def test_chunks_cover_a_heavy_key_in_order(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 700, 1).otherwise(F.col("id")).alias("k"), "id")
    cut = add_chunks(df, ["k"], "id", 100)
    rows = cut.where("k = 1").groupBy(CHUNK).agg(F.count("*").alias("n"), F.min("id").alias("a"), F.max("id").alias("b"))
    rows = sorted(rows.collect(), key=lambda r: r[CHUNK])
    assert sum(r.n for r in rows) == 700 and max(r.n for r in rows) <= 101 and len(rows) >= 7
    assert all(x.b < y.a for x, y in zip(rows, rows[1:]))
    assert cut.where(f"k > 1 AND {CHUNK} IS NOT NULL").count() == 0
    assert CHUNK not in add_chunks(df, ["k"], "id", 1000).columns


def test_chunks_keep_their_bound_whatever_the_order_columns_hold(spark):
    df = spark.range(100_000).select(F.lit("hot").alias("k"), (F.col("id") % 3).alias("a"), F.col("id").alias("b"))
    rows = df.unionByName(spark.createDataFrame([("light", 1, None), ("light", None, 2)], "k string, a long, b long"))
    cut = add_chunks(rows, ["k"], ["a", "b"], 10)
    sizes = cut.where("k = 'hot'").groupBy(CHUNK).agg(F.count("*").alias("n"), F.min(F.struct("a", "b")).alias("low"), F.max(F.struct("a", "b")).alias("high"))
    sizes = sizes.orderBy(CHUNK).collect()
    assert len(sizes) == 10_000 and {r.n for r in sizes} == {10}
    assert all(x.high < y.low for x, y in zip(sizes, sizes[1:]))
    assert cut.where(f"k = 'light' AND {CHUNK} IS NULL").count() == 2
    joins = re.findall(r"Join \[(.*?)\], \[", cut._jdf.queryExecution().executedPlan().toString())
    # Rows meet their chunk by key and order, sums of ranges meet by key and range: never by the key alone.
    assert joins and all(re.search(r"\b(a|b|_range)#", keys) for keys in joins), joins


def test_rows_alike_never_part(spark):
    rows = [("k", n // 7, None if n % 2 else 1) for n in range(210)]
    cut = add_chunks(spark.createDataFrame(rows, "k string, a long, b long"), ["k"], ["a", "b"], 5)
    assert cut.groupBy("k", "a", "b").agg(F.countDistinct(CHUNK).alias("n")).where("n > 1").count() == 0
    assert cut.groupBy(CHUNK).count().agg(F.max("count")).first()[0] <= 5 + 4


def test_many_last_rows_of_a_heavy_key(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("k"), "id")
    tail = tail_rows(df, ["k"], ["id"], 1500)
    assert sorted(r.id for r in tail.collect()) == list(range(2000, 5000))


def test_paged_arrays_keep_every_element(spark):
    df = spark.range(95).select(F.lit(1).alias("k"), "id", F.when(F.col("id") % 7 != 0, F.col("id")).alias("v"))
    for max_rows in (10, 1000):
        pages = paged_arrays(df, ["k"], ["id"], ["v"], 20, max_rows).orderBy("page").collect()
        assert [p.n for p in pages] == [20, 20, 20, 20, 15]
        assert [v for p in pages for v in p.v] == [i if i % 7 else None for i in range(95)]


def test_first_of_equals_wins(spark):
    rows = [(1, 2.0, 3), (1, 2.0, 1), (1, float("nan"), 0), (2, -1.0, 1), (2, None, 2)]
    df = spark.createDataFrame(rows, "k int, v double, t int")
    assert values(argmax_first(df, ["k"], "v", ["t"]), "k", "v", "t") == [(1, 2.0, 1)]


def test_top_rows_are_limited_before_the_exchange(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    plan = first_rows(df, ["k"], ["id"], 5)._jdf.queryExecution().executedPlan().toString()
    partial, exchange = plan.index("Partial"), plan.index("Exchange")
    assert plan.count("WindowGroupLimit") == 2 and exchange < partial


def test_tables(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", 5), (3, "a", 7)], "id int, n string, v int")
    assert values(where_eq(df, n="a", v=None), "id") == [(1,)]
    assert values(get_one(df, ["id"], n="a"), "id") == [(1,)]
    assert values(get_one(df, ["id"], n="z"), "id") == []
    changes = spark.createDataFrame([(2, 1, 50), (2, 2, None), (9, 1, 1)], "id int, seq int, v int")
    assert sorted(values(update_rows(df, changes, ["id"], "seq"), "id", "v"), key=str) == [(1, None), (2, None), (3, 7)]
    owners = spark.createDataFrame([("x", ["f", "f"]), ("y", None)], "o string, names array<string>")
    items = spark.createDataFrame([("f",), ("g",)], "name string")
    assert values(attached(owners, "o", "names", items, "name"), "o", "name") == [("x", "f")]


def test_entity_tables(spark):
    drop_tables(spark)
    try:
        assert create_tables(spark) == ["epoch_train", "eval", "training_iteration", "training_job"]
        row = spark.range(3).select(F.col("id").cast("string").alias("uuid"), F.lit("pending").alias("status"))
        full = row.select([F.col(f.name) if f.name in row.columns else F.lit(None).cast(f.dataType).alias(f.name)
                           for f in spark.table("training_job").schema])
        assert append(full, "training_job") == 3
        assert spark.table("training_job").where("status = 'pending'").count() == 3
    finally:
        drop_tables(spark)
    assert list_tables(spark) == []


def test_layers(spark):
    base = spark.createDataFrame([("a", {"x": "1", "y": "2"}), ("b", {"x": "1"})], "t string, m map<string,string>")
    over = spark.createDataFrame([("a", {"y": "3", "z": "4"})], "t string, o map<string,string>")
    assert dict(values(layered(base, over, ["t"], "m", "o"), "t", "config")) == {
        "a": {"x": "1", "y": "3", "z": "4"}, "b": {"x": "1"},
    }
    rows = spark.createDataFrame([("text_classification",), ("other",)], "task_type string")
    counts = {r.task_type: r.config["trajectory_count"] for r in task_configs(rows).collect()}
    assert counts == {"text_classification": "10", "other": "2"}


def test_requests_and_explicit_nulls(spark):
    blocks = '"prompt":{"id":null},"train_dataset":{"file_name":"d/a.csv"},"eval_dataset":{"id":"1"}'
    texts = [f'{{"project":{{"id":"p"}},{blocks}}}', f'{{"project":{{}},{blocks}}}', '{"project":{"id":"p"}}']
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", F.parse_json("t").alias("request"))
    good, bad = validate_requests(df)
    assert [r.reason.split("'")[1] for r in bad.orderBy("k").collect()] == ["project", "prompt"]
    row = derive_config(good, ["k"]).first()
    assert (row.prompt_id, row.prompt_name, row.think_flag, row.task_type) == (None, "", True, "text_classification")
    assert (row.train_file_path, row.eval_s3_path, row.train_image_root_path) == ("data/a.csv", "media/", None)


def test_cheapest(spark):
    rows = [("gh200", 1, [("r",)], 0), ("b", 5, [], 1), ("c", 7, [("r1",), ("r2",)], 2), ("d", 7, [("r3",)], 3)]
    df = spark.createDataFrame(rows, "name string, price_cents int, regions array<struct<name:string>>, pos int")
    assert values(cheapest(df.withColumn("gpus", F.lit(8)), "pos"), "name", "region") == [("c", "r1")]
    assert values(df.where("pos = 1"), first_region(F.col("regions"))) == [(None,)]


ITERATIONS = (
    "uuid string, training_job_uuid string, iteration_number int, step_type string, step_config string, "
    "start_seq long, iteration_metadata string"
)
EVALS = "uuid string, iteration_uuid string, model_id string, metrics string, start_seq long"


def score(x):
    return None if x is None else f'{{"answer_reward":{{"percentage":{x}}}}}'


def run_best(spark, steps, evals):
    steps = spark.createDataFrame(
        [(u, "j", n, k, "{}" if d is None else f'{{"dataset":"{d}"}}', i, None) for i, (u, n, k, d) in enumerate(steps)],
        ITERATIONS,
    )
    evals = spark.createDataFrame([(f"e{i}", s, m, score(x), i) for i, (s, m, x) in enumerate(evals)], EVALS)
    jobs = spark.createDataFrame([("j", None)], "uuid string, job_metadata string")
    per = iteration_metrics(steps, evals)
    return job_metrics(jobs, steps, per).first(), per, steps, jobs


EVALUATION = "evaluation"


def test_best_model_and_its_pair(spark):
    steps = [("i1", 1, "iteration", None), ("a", 1, EVALUATION, "eval"), ("b", 1, EVALUATION, "train"),
             ("i2", 2, "iteration", None), ("c", 2, EVALUATION, "eval"), ("d", 2, EVALUATION, "train")]
    evals = [("a", "iteration_1_epoch_1", 0.5), ("a", "iteration_1_epoch_2", 0.5), ("b", "iteration_1_epoch_1", 0.1),
             ("c", "iteration_2_epoch_1", 0.5), ("d", "iteration_2_epoch_1", 0.2)]
    row, per, steps, jobs = run_best(spark, steps, evals)
    assert (row.best_iteration, row.best_eval_eval.eval_uuid, row.best_eval_train.accuracy, row.error) == (1, "e0", 0.1, None)
    stored = update_iterations(steps, per).orderBy("iteration_number").collect()
    assert '"accuracy":0.2' in stored[1].iteration_metadata
    paths = eval_file_paths(
        update_jobs(jobs, job_metrics(jobs, steps, per)).select(
            "*", F.lit("p").alias("project_id"), F.lit("r").alias("training_run_id"), F.lit(None).cast("string").alias("project_yaml_config")
        ), "bucket",
    ).first()
    assert paths.eval_file_path == "s3://bucket/media/projects/p/r/unknown_project/training/run_1/eval/eval_eval_epoch_1.csv"


@pytest.mark.parametrize(
    "steps, evals",
    [
        ([("a", 1, EVALUATION, "eval")], [("a", "iteration_1_epoch_1", 0.5)]),
        ([("a", 1, EVALUATION, "eval"), ("b", 1, EVALUATION, "train")], [("a", "iteration_1_epoch_1", 0.5)]),
        ([("a", 1, EVALUATION, "eval"), ("b", 1, EVALUATION, "train")],
         [("a", "iteration_1_epoch_1", 0.5), ("a", "iteration_1_epoch_2", None), ("b", "iteration_1_epoch_1", 0.5)]),
        ([("a", 1, EVALUATION, "eval"), ("b", 1, EVALUATION, "train"), ("c", 1, EVALUATION, None)],
         [("a", "iteration_1_epoch_1", 0.5), ("b", "iteration_1_epoch_1", 0.5)]),
        ([("i", 2, "iteration", None), ("a", 1, EVALUATION, "eval"), ("b", 1, EVALUATION, "train"),
          ("c", 2, EVALUATION, "eval")],
         [("a", "iteration_1_epoch_1", 0.5), ("b", "iteration_1_epoch_1", 0.5), ("c", "iteration_1_epoch_1", 0.1)]),
        ([("a", 1, EVALUATION, "eval"), ("b", 1, EVALUATION, "train")],
         [("a", "iteration_1_epoch_1", -1.0), ("b", "iteration_1_epoch_1", 0.5)]),
    ],
)
def test_incomplete_results_void_the_job(spark, steps, evals):
    row, per, _, _ = run_best(spark, steps, evals)
    assert row.best_iteration is None and row.error and per.count() == 0


def test_results_are_filed_by_model_id(spark):
    steps = [("a", 1, EVALUATION, "eval"), ("b", 1, EVALUATION, "train"), ("c", 2, EVALUATION, "eval")]
    evals = [("a", "iteration_1_epoch_1", 0.5), ("b", "iteration_1_epoch_1", 0.5), ("c", "iteration_1_epoch_1", 0.1)]
    row, per, _, _ = run_best(spark, steps, evals)
    assert values(per, "iteration_number", "best_eval_eval.eval_uuid") == [(1, "e2")]
    assert row.best_iteration == 1


def test_jobs_without_evaluations_have_empty_metrics(spark):
    row, per, steps, jobs = run_best(spark, [("i", 1, "iteration", None)], [("zz", "iteration_1_epoch_1", 0.5)])
    assert row.best_iteration is None and row.error is None
    stored = update_jobs(jobs, job_metrics(jobs, steps, per)).first().job_metadata
    assert stored == '{"metrics":{"best_eval_eval":null,"best_eval_train":null,"best_iteration":null}}'


def test_cancel_is_void_on_a_finished_job(spark):
    jobs = spark.sql("""
        SELECT id AS uuid, CASE id WHEN 'd' THEN 'completed' ELSE 'pending' END AS status,
               timestamp_ntz'2026-01-01 00:00:00' AS created_at, CAST(NULL AS timestamp_ntz) AS started_at,
               CAST(NULL AS timestamp_ntz) AS completed_at, CAST(NULL AS double) AS time_taken, '{"k":1}' AS job_metadata
        FROM VALUES ('a'), ('b'), ('c'), ('d') AS t(id)""")
    rows = [("a", 1, "running", None), ("a", 2, "failed", "boom"), ("a", 3, "cancelled", None), ("b", 1, "cancelled", None),
            ("b", 2, "cancelled", None), ("b", 3, "running", None), ("b", 4, "cancelled", None), ("d", 1, "cancelled", None)]
    moves = spark.createDataFrame(rows, "uuid string, seq int, status string, error string").withColumn(
        "at", F.expr("timestamp_ntz'2026-01-01 00:00:00' + make_dt_interval(0, 0, seq)"))
    for max_rows in (100, 2):
        got = {r.uuid: r for r in apply_transitions(jobs, moves, max_rows).collect()}
        assert [got[k].status for k in "abcd"] == ["failed", "cancelled", "pending", "completed"]
        assert (got["a"].time_taken, got["b"].time_taken, got["d"].time_taken) == (2.0, 4.0, None)
        assert got["a"].job_metadata == '{"k":1,"error":"boom"}' and got["b"].job_metadata == '{"k":1}'


def test_time_left(spark):
    jobs = spark.sql("""
        SELECT id AS uuid, s AS status, timestamp_ntz'2026-01-01 00:00:00' AS created_at,
               CAST(NULL AS timestamp_ntz) AS completed_at, c AS project_yaml_config
        FROM VALUES ('a', 'pending', NULL), ('b', 'running', '{"no_iterations":4}'), ('c', 'running', '{}'),
                    ('d', 'cancelled', '{}') AS t(id, s, c)""")
    steps = spark.sql("""
        SELECT j AS training_job_uuid, n AS iteration_number, 'iteration' AS step_type, m AS time_taken,
               timestamp_ntz'2026-01-01 00:10:00' AS completed_at, 1L AS start_seq
        FROM VALUES ('b', 1, 9.0D), ('b', 2, 10.0D), ('c', 1, 0.0D) AS t(j, n, m)""")
    report = job_time(jobs, steps, F.expr("timestamp_ntz'2026-01-01 02:00:00'"))
    got = {r.job_uuid: (r.elapsed_time, r.remaining_time, r.estimated_time) for r in report.collect()}
    assert got == {"a": (120.0, -55.0, 65.0), "b": (120.0, 25.0, 145.0), "c": (120.0, -55.0, 65.0), "d": (120.0, 0.0, 120.0)}


def test_accuracy_gates(spark):
    jobs = spark.createDataFrame(
        [("a", "running", None), ("b", "completed", "{}"), ("c", "completed", '{"metrics":{"best_iteration":null}}')],
        "uuid string, status string, job_metadata string",
    )
    report = accuracy_report(jobs, spark.createDataFrame([], ITERATIONS))
    got = {r.job_uuid: (r.success, r.message, r.train_accuracies) for r in report.collect()}
    assert got["a"] == (False, "Job is not completed. Current status: running", [])
    assert got["b"] == (False, "Job has no metrics populated in metadata", [])
    assert got["c"] == (True, "No iterations found for this job", [])
