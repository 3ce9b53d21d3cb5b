import json
import pickle
import time
from datetime import datetime, timedelta

import pytest
from logmaker import as_lines, random_log
from pyspark.sql import functions as F

from runledger.operators.spans import build_spans, span_changes, track
from runledger.plans.jobs import job_outcomes
from runledger.sources.logs import decode_events, read_event_lines
from runledger.sources.tail import ListedTailReader, TailReader, tail_lines, whole_lines
from runledger.streaming.spans import current_spans, events_of_lines, stream_spans, upsert_spans
from runledger.streaming.stalled import stream_stalled

LINES = "job_uuid string, seq long, line string"


def grow(folder, job, text):
    path = folder / job / "log.json"
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("ab") as out:
        out.write(text.encode() if isinstance(text, str) else text)


@pytest.fixture
def spans_table(spark):
    name = f"spans_{time.time_ns()}"
    yield name
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def batch_spans(spark, logs):
    """Spans of whole logs; a line's number is the place of its first byte."""
    rows = []
    for job, lines in logs.items():
        at = 0
        for line in lines:
            rows.append((job, at + 1, line))
            at += len(line.encode()) + 1
    return build_spans(decode_events(spark.createDataFrame(rows, LINES))[0])


def as_text(df):
    return sorted(map(str, df.collect()))


def test_stream_equals_batch_over_restarts_and_half_lines(spark, tmp_path, spans_table):
    logs = {f"job{i}": [line for _, _, line in as_lines("", random_log(200 + i, 90))] for i in range(3)}
    whole = {job: "".join(line + "\n" for line in lines).encode() for job, lines in logs.items()}
    landing, checkpoint = tmp_path / "in", str(tmp_path / "check")
    done = dict.fromkeys(whole, 0)
    for share in (0.21, 0.22, 0.7, 1.0):
        for job, text in whole.items():
            end = int(len(text) * share)  # in the middle of a line, mostly
            grow(landing, job, text[done[job] : end])
            done[job] = end
        events = events_of_lines(tail_lines(spark, str(landing), split=1000))
        stream_spans(events, spans_table, checkpoint, trigger={"availableNow": True}, buckets=2).awaitTermination()
    want, got = batch_spans(spark, logs), current_spans(spark, spans_table)
    assert as_text(got) == as_text(want)
    assert job_outcomes(got).count() == job_outcomes(want).count()
    batches = {(r.query, r.id) for r in spark.table(spans_table).select("batch.*").collect()}
    assert len(batches) > 1 and {query for query, _ in batches} == {checkpoint}


def test_a_batch_that_comes_again_changes_nothing(spark, spans_table):
    rows = [("a", seq, line) for seq, line in enumerate((x for _, _, x in as_lines("", random_log(5, 80))), 1)]
    changes = span_changes(track(decode_events(spark.createDataFrame(rows, LINES))[0], max_rows=None))
    parts = [changes.where(f"seq % 3 = {n}") for n in range(3)]
    for n in (0, 1, 1, 2, 0):
        upsert_spans(parts[n], spans_table, "q", n, buckets=2)
    assert as_text(current_spans(spark, spans_table)) == as_text(build_spans(decode_events(spark.createDataFrame(rows, LINES))[0]))


def test_spans_follow_a_log_under_a_timed_trigger(spark, tmp_path, spans_table):
    lines = [line for _, _, line in as_lines("", random_log(31, 60))]
    grow(tmp_path / "in", "j", "".join(x + "\n" for x in lines[:20]))
    events = events_of_lines(tail_lines(spark, str(tmp_path / "in")))
    running = stream_spans(events, spans_table, str(tmp_path / "check"), trigger={"processingTime": "1 second"}, buckets=2)
    try:
        for upto, before in ((20, 0), (60, 20)):
            grow(tmp_path / "in", "j", "".join(x + "\n" for x in lines[20:upto]) if before else "")
            want, deadline = as_text(batch_spans(spark, {"j": lines[:upto]})), time.time() + 90
            while time.time() < deadline:
                if spark.catalog.tableExists(spans_table) and as_text(current_spans(spark, spans_table)) == want:
                    break
                time.sleep(1)
            assert as_text(current_spans(spark, spans_table)) == want
    finally:
        running.stop()


def test_an_event_without_a_time_gets_that_of_its_batch(spark, tmp_path, spans_table):
    grow(tmp_path / "in", "j", '{"phase":"PROJECT","event":"start","data":{}}\n')
    events = events_of_lines(tail_lines(spark, str(tmp_path / "in")))
    stream_spans(events, spans_table, str(tmp_path / "check"), trigger={"availableNow": True}).awaitTermination()
    batch = json.loads((tmp_path / "check" / "offsets" / "0").read_text().splitlines()[1])["batchTimestampMs"]
    (row,) = current_spans(spark, spans_table).collect()
    assert row.created_at == datetime(1970, 1, 1, 5, 30) + timedelta(milliseconds=batch)


def read_all(reader, start, end):
    return [row for p in reader.partitions(start, end) for b in reader.read(p) for row in zip(*b.to_pydict().values())]


@pytest.mark.parametrize("tasks", [1, 5, 1000])
@pytest.mark.parametrize("split", [1, 2, 3, 7, 1000])
def test_ranges_hold_each_line_once(tmp_path, split, tasks):
    text = "a\n\nbcd é\n" + "x" * 50 + "\r\nlast\n"
    for job, more in (("p", ""), ("q", "half")):
        grow(tmp_path, job, text + more)
    grow(tmp_path, "r", "no end yet")
    reader = TailReader(str(tmp_path), r"\.json$", split, tasks)
    end = reader.latestOffset()
    size = len(text.encode())
    assert end == {str(tmp_path / "p/log.json"): size, str(tmp_path / "q/log.json"): size, str(tmp_path / "r/log.json"): 0}
    want = [(0, "a"), (2, ""), (3, "bcd é"), (10, "x" * 50), (62, "last")]
    for job in "pq":
        assert sorted((at, line) for file, at, line in read_all(reader, {}, end) if f"/{job}/" in file) == want
    grow(tmp_path, "q", " is whole now\nnext")
    later = reader.latestOffset()
    assert [(at, line) for _, at, line in read_all(reader, end, later)] == [(size, "half is whole now")]
    assert reader.partitions(later, later) == []


def test_small_files_share_a_task(tmp_path):
    for n in range(300):
        grow(tmp_path, f"j{n}", "line one\nline two\n")
    reader = TailReader(str(tmp_path), r"\.json$", 1 << 20, 8)
    end = reader.latestOffset()
    assert 8 <= len(reader.partitions({}, end)) <= 16
    assert len(read_all(reader, {}, end)) == 600


@pytest.mark.parametrize("split", [1, 7, 1000])
def test_offsets_of_many_files_are_names_of_lists(tmp_path, split):
    """each offset named every file, and the driver kept several of them and the ranges of all tasks."""
    logs, state = tmp_path / "in", f"file://{tmp_path}/state"
    for n in range(300):
        grow(logs, f"job{n}", "line one\nline é\nhalf")
    (logs / "job0" / "other.txt").write_text("no\n")
    reader, plain = ListedTailReader(f"file://{logs}", r"\.json$", split, 8, state), TailReader(str(logs), r"\.json$", split, 8)
    assert reader.initialOffset() == {}
    end, whole = reader.latestOffset(), plain.latestOffset()
    tasks = reader.partitions({}, end)
    assert len(json.dumps(end)) < 300 and max(len(pickle.dumps(t)) for t in tasks) < 300
    assert sorted(read_all(reader, {}, end)) == sorted(read_all(plain, {}, whole)) and len(tasks) == len(plain.partitions({}, whole))
    assert reader.latestOffset() == end and reader.partitions(end, end) == []
    assert ListedTailReader(f"file://{logs}", r"\.json$", split, 8, state).latestOffset() == end
    reader.commit(end)
    assert [p.name for p in (tmp_path / "state").glob("**/*") if p.is_file()] == [end["list"].rpartition("/")[2]]
    grow(logs, "job7", " is whole\n")
    grow(logs, "job1000", "new\n")
    again = ListedTailReader(f"file://{logs}", r"\.json$", split, 8, f"{state}/other")  # after a restart
    assert len(read_all(again, {}, end)) == 600 and again.known == {f: n for f, n in whole.items()}
    later = again.latestOffset()
    assert sorted(line for _, _, line in read_all(again, end, later)) == ["half is whole", "new"]
    fresh = ListedTailReader(f"file://{logs}", r"\.json$", split, 8, state)  # a restart after all batches were done
    assert read_all(fresh, later, fresh.latestOffset()) == []


def test_a_stream_with_a_state_folder_goes_on_after_a_restart(spark, tmp_path):
    for n, text in enumerate(("a\nb\nc", "d\n", "", "e\nf\n")):
        grow(tmp_path / "in", "j", text)
        grow(tmp_path / "in", f"k{n}", text)
        lines = tail_lines(spark, str(tmp_path / "in"), state=str(tmp_path / "state")).select("line")
        running = lines.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check"))
        running.trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.line for r in spark.read.schema("line string").parquet(str(tmp_path / "out")).collect()) == sorted(["a", "b", "cd", "e", "f", "a", "b", "d", "e", "f"])


def test_the_end_of_the_last_whole_line_is_found_block_by_block():
    for text in (b"", b"\n", b"abc", b"abc\ndef", b"abc\n" + b"y" * 200_000, b"y" * 200_000 + b"\n"):
        got = whole_lines(len(text), lambda low, n, t=text: t[low : low + n], 0)
        assert got == text.rfind(b"\n") + 1


def test_stalled_jobs_are_reported_once(spark, tmp_path):
    events = [("a", "PROJECT", "start"), ("b", "PROJECT", "start"), ("b", "PROJECT", "end")]
    schema = "job_uuid string, phase string, event string"
    spark.createDataFrame(events, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = (
        stream_stalled(stream, 500).writeStream.format("memory").queryName("stalled").outputMode("update")
        .option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="1 second").start()
    )
    deadline = time.time() + 60
    while time.time() < deadline and spark.table("stalled").count() == 0:
        time.sleep(1)
    time.sleep(2)
    query.stop()
    assert [r.job_uuid for r in spark.table("stalled").collect()] == ["a"]


def test_lines_are_numbered_over_files_and_splits(spark, tmp_path):
    for name, first in (("a", 0), ("b", 400)):
        (tmp_path / name).write_text("".join(f"line {first + i}\n" for i in range(400)))
    for size in ("134217728", "1000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            rows = read_event_lines(spark, f"{tmp_path}/*", F.lit("j")).collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert sorted((r.seq, r.line) for r in rows) == [(i + 1, f"line {i}") for i in range(800)]
    assert read_event_lines(spark, f"{tmp_path}/*", first_match=True).count() == 400


def test_listed_names_are_as_stored(spark, tmp_path):
    from runledger.sources.objects import list_objects

    root = tmp_path / "q"
    inner = root / str(root).strip("/") / "a b+c%20.txt"
    inner.parent.mkdir(parents=True)
    inner.write_text("x")
    for path in (str(root), f"{root}/", f"file://{root}"):
        assert [(r.name, r.size) for r in list_objects(spark, path).collect()] == [(str(inner.relative_to(root)), 1)]
