"""Reports from stored and from fresh metrics, settings from layers, decoding of the fields asked for."""

import pytest
from logmaker import as_lines, random_log
from pyspark.sql import functions as F

from runledger.operators.best import (
    iteration_metrics, job_metrics, update_iterations, update_jobs, with_iteration_metrics, with_job_metrics,
)
from runledger.operators.spans import DECIDING, build_spans, iteration_starts, iterations_of, rejected_starts, track
from runledger.plans.layers import folded_settings, read_layers
from runledger.plans.reports import accuracy_report, eval_file_paths
from runledger.sources.logs import decode_events, decode_lines
from workload.runs import _jobs, _results, _steps

SF = "/root/testdata/sf0.001"
LINES = "job_uuid string, seq long, line string"


def as_text(df):
    return sorted(map(str, df.collect()))


def test_reports_agree_on_stored_and_fresh_metrics(spark):
    jobs, steps = _jobs(spark, SF), _steps(spark, SF)
    per_iteration = iteration_metrics(steps, _results(steps))
    per_job = job_metrics(jobs, steps, per_iteration)
    stored_jobs, stored_steps = update_jobs(jobs, per_job), update_iterations(steps, per_iteration)
    fresh_jobs, fresh_steps = with_job_metrics(jobs, per_job), with_iteration_metrics(steps, per_iteration)
    assert as_text(accuracy_report(stored_jobs, stored_steps)) == as_text(accuracy_report(fresh_jobs, fresh_steps))
    assert as_text(eval_file_paths(stored_jobs, "b")) == as_text(eval_file_paths(fresh_jobs, "b"))


def test_layers_go_over_each_other(spark, tmp_path):
    documents = {
        "a/all": '{"x": 1, "y": "text", "z": null, "deep": {"b": 2, "a": [1, "q"]}, "true": true}',
        "b/one": '{"x": null, "new": 1.50}', "b/two": "[1, 2]", "b/three": "not json", "b/four": "{}", "c/one": '{"y": "", "x": "3"}',
    }
    for name, text in documents.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / f"{name}.json").write_text(text)
    targets = spark.createDataFrame([("t1", "one"), ("t2", "two"), ("t3", None), ("t4", "nowhere"), ("t5", "three")], "target string, own string")
    layers = {"a": F.lit("all"), "b": F.col("own"), "c": F.col("own")}
    got = {(r.target, r.setting): (r.value, r.origin) for r in folded_settings(targets, "target", layers, read_layers(spark, str(tmp_path))).collect()}
    base = {"x": ("1", "a"), "y": ("text", "a"), "z": (None, "a"), "deep": ('{"a":[1,"q"],"b":2}', "a"), "true": ("true", "a")}
    want = {(t, k): v for t in ("t1", "t2", "t3", "t4", "t5") for k, v in base.items()}
    want |= {("t1", "x"): ("3", "c"), ("t1", "y"): ("", "c"), ("t1", "new"): ("1.5", "b")}
    assert got == want


@pytest.mark.parametrize("seed", range(3))
def test_deciding_fields_are_enough_to_tell_spans(spark, seed):
    rows = [("j", seq, line) for seq, line in enumerate((x for _, _, x in as_lines("", random_log(seed, 120))), 1)] + [("j", 500, "x"), ("j", 501, " ")]
    lines = spark.createDataFrame(rows, LINES)
    whole, few = decode_events(lines), decode_events(lines, fields=DECIDING)
    assert as_text(few[1]) == as_text(whole[1])
    starts = iterations_of(build_spans(whole[0])).where("step_type = 'iteration'").select("start_seq", "iteration_number")
    assert as_text(iteration_starts(track(few[0])).select("start_seq", F.col("number").alias("iteration_number"))) == as_text(starts)
    assert as_text(rejected_starts(track(few[0]))) == as_text(rejected_starts(track(whole[0])))


def test_fields_asked_for_and_one_parse_for_both(spark):
    lines = spark.createDataFrame([("j", 1, '{"phase":"PROJECT","event":"start","data":{}}'), ("j", 2, "bad")], LINES)
    assert decode_lines(lines, fields=("phase",)).columns == ["job_uuid", "seq", "line", "reason", "phase"]
    with pytest.raises(ValueError):
        decode_lines(lines, fields=("nothing",))
    good, bad = decode_events(lines, fields=("phase", "event"), once=True)
    assert as_text(good) == ["Row(job_uuid='j', seq=1, phase='PROJECT', event='start')"] and bad.count() == 1
    assert "variant" not in good._jdf.queryExecution().executedPlan().toString().lower()
