"""Memory, files and tasks that must not grow with the rows of one task, one key or one folder."""

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from runledger.operators.best import iteration_metrics
from runledger.operators.tables import job_tree
from runledger.plans import layers
from runledger.plans.config import WRITERS, write_configs
from runledger.plans.layers import read_layers
from runledger.session import setting
from workload import runs, tables


def test_configurations_are_written_without_sorting_by_type(spark, tmp_path, monkeypatch):
    """the sort held all rows of a task; open files hold none."""
    seen, name, write = [], "spark.sql.maxConcurrentOutputFileWriters", DataFrameWriter.json
    before = spark.conf.get(name)
    monkeypatch.setattr(DataFrameWriter, "json", lambda self, path: (seen.append(spark.conf.get(name)), write(self, path)))
    types = WRITERS + 3  # more than stay open
    rows = spark.range(0, 400, 1, 2).select((F.col("id") % types).cast("string").alias("task_type"), F.col("id").cast("string").alias("stem"))
    write_configs(rows, "stem", f"{tmp_path}/out")
    assert seen == [str(WRITERS)] and spark.conf.get(name) == before
    found = spark.read.schema("name string, config string, task_type string").json(f"{tmp_path}/out").collect()
    assert sorted(r.name for r in found) == sorted(f"{i % types}_{i}" for i in range(400))
    assert all(r.name.startswith(f"{r.task_type}_") for r in found)


def test_documents_of_one_split_are_written_by_all_cores(spark, tmp_path, monkeypatch):
    """a table of one split had its files written by one task."""
    dealt = []
    monkeypatch.setattr(tables, "spread", lambda df: (dealt.append(df.rdd.getNumPartitions()), df)[1])
    rows = spark.range(0, 5, 1, 1).selectExpr("CAST(id AS STRING) AS name", "'{}' AS value")
    tables._write_documents(rows, f"{tmp_path}/0_a")
    assert dealt == [1] and len(list((tmp_path / "0_a").glob("*.json"))) == 5


def test_many_documents_are_read_by_few_tasks(spark, tmp_path):
    """32 files made a task; now some thousand do, and only files of the layers' own folders are documents."""
    for layer in ("0_a", "1_b"):
        (tmp_path / layer / "k=1").mkdir(parents=True)
        for n in range(200):
            (tmp_path / layer / f"n {n}+.json").write_text('{"x":' + str(n) + '}')
        (tmp_path / layer / "k=1" / "deep.json").write_text('{"deep":1}')
        (tmp_path / layer / "other.txt").write_text('{"text":1}')
    (tmp_path / "stray.json").write_text('{"stray":1}')
    name = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(name)
    rows = read_layers(spark, str(tmp_path))
    assert spark.conf.get(name) == before
    assert sorted((r.layer, r.name, r.setting, r.value) for r in rows.collect()) == sorted(
        (layer, f"n {n}+", "x", str(n)) for layer in ("0_a", "1_b") for n in range(200)
    )
    # What is read back are the parts that the reading tasks wrote.
    assert len(rows.inputFiles()) <= 2 * spark.sparkContext.defaultParallelism


def test_large_trees_are_dealt_to_more_tasks(spark):
    """rows per task grew with the tables, whatever their size."""
    def small(**names):
        return spark.range(40).selectExpr(*[f"{value} AS {name}" for name, value in names.items()])

    jobs = small(uuid="CAST(id AS STRING)", status="'on'")
    steps = small(uuid="concat('s', id)", training_job_uuid="CAST(id AS STRING)", step_type="'t'", iteration_number="1")
    epochs = small(iteration_uuid="concat('s', id % 20)", epoch_number="CAST(id AS INT)", uuid="concat('e', id)")
    evals = small(iteration_uuid="concat('s', id % 10)", model_id="'m'", dataset="'d'", uuid="concat('v', id)")
    few, many = job_tree(jobs, steps, epochs, evals), job_tree(jobs, steps, epochs, evals, task_rows=10)
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect())) and few.count() == 100
    assert many.rdd.getNumPartitions() == 8  # 80 rows, of which the session's 4 shuffle partitions would hold 20 each


def test_lines_are_made_after_rows_are_dealt(spark, tmp_path, capsys):
    """a filter on lines was worked out before the rows of a scan with few splits were dealt to all cores."""
    spark.range(0, 40, 1, 1).selectExpr(
        "id AS event_id", "id % 3 AS user_id", "timestamp_ntz'2024-01-01 00:00:00' AS ts", "'view' AS event_type",
        "CAST(id AS DOUBLE) AS value", "concat('{\"k\":', id, '}') AS props",
    ).write.parquet(f"{tmp_path}/events.parquet")
    lines = runs.run_log(spark, str(tmp_path)).where(F.trim("line") != "")
    assert lines.count() == 40
    lines.explain()
    below = capsys.readouterr().out.partition("RoundRobinPartitioning")
    assert below[1] and "date_format" in below[0] and "date_format" not in below[2]


def test_best_models_of_jobs_move_no_ids_of_results(spark, tmp_path, capsys):
    """the ids of results, which the query does not return, moved twice."""
    spark.createDataFrame(
        [(1, 1, 10.0, 0.04, 0.02), (1, 2, 20.0, 0.04, 0.06), (2, 1, 30.0, 0.0, 0.02), (3, 1, 5.0, 0.01, 0.01)],
        "l_orderkey long, l_linenumber int, l_extendedprice double, l_discount double, l_tax double",
    ).selectExpr("*", "'N' AS l_returnflag", "timestamp_ntz'2024-01-01 00:00:00' AS l_shipdate", "1.0D AS l_quantity").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = runs.best_model_per_job(spark, str(tmp_path))
    rows = {(r.training_job_uuid, r.best_iteration, r.model_id, r.eval_accuracy, r.train_accuracy) for r in found.collect()}
    assert rows == {("1", 2, "iteration_2_epoch_1", 6.0, 5.0), ("3", 1, "iteration_1_epoch_1", 1.0, 2.0)}
    capsys.readouterr()
    found.explain()
    assert "eval_uuid" not in capsys.readouterr().out
    with pytest.raises(ValueError, match="a result has model_id"):
        iteration_metrics(runs._steps(spark, str(tmp_path)), runs._results(runs._steps(spark, str(tmp_path))), parts=("accuracy",))


def test_results_move_once_and_unsorted(spark, monkeypatch, capsys):
    """results were sorted before they moved, moved twice, and three tables were stored on the way."""
    steps = spark.range(40).selectExpr(
        "explode(array('iteration', 'eval', 'train')) AS kind", "CAST(id % 10 AS STRING) AS training_job_uuid",
        "CAST(id DIV 10 AS INT) AS iteration_number", "id",
    ).selectExpr(
        "concat(id, kind) AS uuid", "training_job_uuid", "iteration_number", "id * 3 + length(kind) AS start_seq",
        "CASE kind WHEN 'iteration' THEN kind ELSE 'evaluation' END AS step_type",
        "CASE kind WHEN 'iteration' THEN '{}' ELSE to_json(named_struct('dataset', kind)) END AS step_config",
    )
    evals = steps.where("step_type = 'evaluation'").selectExpr("*", "explode(array(1, 2)) AS epoch").selectExpr(
        "uuid AS iteration_uuid", "concat(uuid, '-', epoch) AS uuid", "concat('iteration_', iteration_number, '_epoch_', epoch) AS model_id",
        "concat('{\"answer_reward\":{\"percentage\":', epoch, '}}') AS metrics", "start_seq * 2 + epoch AS start_seq",
    )
    stored, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path: (stored.append(path), write(self, path)))
    few, many = iteration_metrics(steps, evals), iteration_metrics(steps, evals, task_rows=10)
    few.explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange hashpartitioning(training_job_uuid") == 1
    for below in plan.split("Exchange hashpartitioning(iteration_uuid")[1:]:
        assert "Aggregate" not in below.partition("Range")[0]
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect())) and few.count() == 40
    assert {r.best_eval_train.eval_uuid for r in many.collect()} == {f"{n}train-2" for n in range(40)}
    assert stored == [] and many.rdd.getNumPartitions() == 12  # 120 steps


LINES = "l_orderkey long, l_linenumber int, l_extendedprice double, l_discount double, l_tax double"


def _lines(spark, folder):
    """Three orders as tables: one whole, one without a score, one with a tie."""
    rows = [(1, 1, 10.0, 0.04, 0.02), (1, 2, 20.0, 0.04, 0.06), (2, 1, 30.0, 0.0, 0.02), (3, 1, 5.0, 0.01, 0.01), (3, 2, 6.0, 0.01, 0.01)]
    spark.createDataFrame(rows, LINES).selectExpr(
        "*", "'N' AS l_returnflag", "timestamp_ntz'2024-01-01 00:00:00' AS l_shipdate", "1.0D AS l_quantity"
    ).write.parquet(f"{folder}/lineitem.parquet")
    spark.range(1, 5).selectExpr(
        "id AS o_orderkey", "id AS o_custkey", "'F' AS o_orderstatus", "timestamp_ntz'2024-01-01 00:00:00' AS o_orderdate",
        "'1-URGENT' AS o_orderpriority",
    ).write.parquet(f"{folder}/orders.parquet")


def test_results_are_sorted_once_and_dealt_by_the_number_of_steps(spark, tmp_path, capsys):
    """results were sorted and reduced twice, steps moved in two parts, and tasks by step grew with the tables."""
    _lines(spark, tmp_path)
    steps = runs._steps(spark, str(tmp_path))
    found = iteration_metrics(steps, runs._results(steps), task_rows=2)
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        found.explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange hashpartitioning(iteration_uuid") == plan.count("Sort [iteration_uuid") == 1
    assert plan.count("Exchange hashpartitioning(uuid") == 1 and "Aggregate(key=[iteration_uuid" not in plan
    n = -(-steps.count() // 2)
    assert [part.partition(")")[0].rpartition(", ")[2] for part in plan.split("Exchange hashpartitioning(")[1:]] == [str(n)] * 3
    rows = {(r.training_job_uuid, r.iteration_number, r.best_eval_eval.eval_uuid, r.best_eval_train.eval_uuid) for r in found.collect()}
    assert rows == {
        ("1", 1, "1-10000001000-eval-1", "1-10000001000-train-1"), ("1", 2, "1-20000002000-eval-1", "1-20000002000-train-1"),
        ("3", 1, "3-10000000500-eval-1", "3-10000000500-train-1"), ("3", 2, "3-20000000600-eval-1", "3-20000000600-train-1"),
    }


def test_a_best_result_filed_under_another_number_finds_its_pair(spark):
    """A result that is not filed where it was evaluated goes a longer way; of two under one number the later slot wins."""
    steps = [(f"{kind}{n}", "a", n, n * 10 + i, "evaluation", '{"dataset":"' + kind + '"}') for n in (1, 2, 3) for i, kind in enumerate(("eval", "train"))]
    about = {"eval1": (2, 5.0), "eval2": (1, 7.0), "eval3": (1, 6.0), "train1": (1, 1.0), "train2": (2, 2.0), "train3": (3, 3.0)}
    evals = [
        (f"r{step}", step, f"iteration_{n}_epoch_1", '{"answer_reward":{"percentage":' + str(score) + "}}", at)
        for at, (step, (n, score)) in enumerate(about.items())
    ]
    found = iteration_metrics(
        spark.createDataFrame(steps, "uuid string, training_job_uuid string, iteration_number int, start_seq long, step_type string, step_config string"),
        spark.createDataFrame(evals, "uuid string, iteration_uuid string, model_id string, metrics string, start_seq long"),
    )
    rows = [(r.iteration_number, r.best_eval_eval.eval_uuid, r.best_eval_train.eval_uuid, r.first_seq) for r in found.collect()]
    assert sorted(rows) == [(1, "reval3", "rtrain1", 10), (2, "reval1", "rtrain2", 20)]


@pytest.mark.parametrize("name", ["metrics_or_error", "result_files"])
def test_reports_on_jobs_move_and_store_no_ids_of_results(spark, tmp_path, monkeypatch, capsys, name):
    """ids of results moved twice, and F7 stored the metrics of all iterations to read them once."""
    _lines(spark, tmp_path)
    stored, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path: (stored.append(path), write(self, path)))
    found = getattr(runs, name)(spark, str(tmp_path))
    found.explain()
    assert "eval_uuid" not in capsys.readouterr().out and stored == []
    assert {r[0]: r["best_iteration"] for r in found.collect()} == {"1": 2, "2": None, "3": 1, "4": None}


def test_metadata_is_written_after_metrics_met_their_rows(spark, tmp_path, capsys):
    """JSON texts of the metrics moved to the steps."""
    _lines(spark, tmp_path)
    found = runs.stored_iteration_metadata(spark, str(tmp_path))
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        found.explain()
    for below in capsys.readouterr().out.split("Exchange hashpartitioning(training_job_uuid")[1:]:
        assert "to_json(struct(best_eval_eval" not in below.partition("Exchange")[0]
    assert {(r[0], r[1], r.eval_uuid) for r in found.collect()} == {
        ("1", 1, "1-10000001000-eval-1"), ("1", 2, "1-20000002000-eval-1"), ("2", 1, None),
        ("3", 1, "3-10000000500-eval-1"), ("3", 2, "3-20000000600-eval-1"),
    }


def test_documents_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    """F8: the driver held a file status of each document."""
    texts = {"n 1+": b'{"x":"\xc3\xa9"}', "n%202": b'{"x":null}', "bad": b"{", "list": b"[1]", "raw": b'{"x":"\xff"}'}
    for layer in ("0_a", "_1 b"):
        (tmp_path / layer / "deep").mkdir(parents=True)
        for name, text in texts.items():
            (tmp_path / layer / f"{name}.json").write_bytes(text)
        for other in ("_hidden.json", ".hidden.json", "x.txt", "deep/y.json"):
            (tmp_path / layer / other).write_text('{"no":1}')
    (tmp_path / "stray.json").write_text('{"no":1}')
    want = sorted(map(str, layers._by_spark(spark, str(tmp_path), len(tmp_path.parts) + 1).collect()))
    monkeypatch.setattr(layers, "_by_spark", None)
    got = layers._documents(spark, str(tmp_path))
    assert got.inputFiles() == [] and sorted(map(str, got.collect())) == want and len(want) == 10
    assert sorted(map(str, layers._documents(spark, f"file://{tmp_path}").collect())) == want
    rows = {(r.layer, r.name, r.setting, r.value) for r in read_layers(spark, str(tmp_path)).collect()}
    assert {("0_a", "n 1+", "x", "é"), ("_1 b", "n%202", "x", None)} <= rows
