"""Registered queries and table changes in a session without any of the settings of ``get_session``."""

import json
import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def told(tmp_path_factory):
    """What ``plain_session.py`` finds, in a Python of its own: a session's settings outlive their session."""
    folder = tmp_path_factory.mktemp("plain")
    env = os.environ | {"PYTHONPATH": f"{ROOT}:{ROOT / 'tests'}"}
    run = subprocess.run([sys.executable, ROOT / "tests/plain_session.py"], cwd=folder, env=env, capture_output=True, text=True, timeout=1200)
    assert run.returncode == 0, run.stderr[-3000:]
    return json.loads(run.stdout.splitlines()[-1])


def test_every_query_equals_its_sql(told):
    assert len(told["queries"]) > 70
    assert {name: verdict for name, verdict in told["queries"].items() if not verdict.startswith(("ok", "rows only"))} == {}


def test_changes_leave_other_partitions_alone(told):
    awkward = "it's \\ 1/2=%"
    assert told["start"] == [[1, "a", None], [2, "b", None], [3, "c", "x"], [4, "d", "x"], [5, "e", awkward], [6, "f", "y"]]
    upserted = [[1, "A", "x"], [2, "b", None], [3, "c", "x"], [4, "d", "x"], [5, "E", awkward], [6, "f", "y"], [9, "n", None], [10, "e", None]]
    assert told["upserted"] == upserted
    emptied = [r for r in upserted if r[0] != 6]
    assert told["emptied"] == emptied
    assert told["null_emptied"] == [r for r in emptied if r[2] is not None]
    assert told["null_again"] == [[2, "moved", "new"], *told["null_emptied"][1:], [11, "z", None]]
    assert told["cleaned"] == told["null_again"] and told["removed"] > 0


def test_a_failure_between_partitions_loses_nothing(told):
    assert told["torn"] and [[k, p] for k, _, p in told["after_failure"]] == [[k, p] for k, _, p in told["before_failure"]]
    assert "old" in {v for _, v, _ in told["after_failure"]} <= {"old", "new"}
    assert told["repeated"] == sorted([[k, "new", p] for k, _, p in told["before_failure"]])


def test_partitions_of_numbers_and_dates(told):
    assert told["numbers"] == [[1, "c", 7, None], [2, "b", None, "2024-01-01"]]
