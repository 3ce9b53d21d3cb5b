"""A stream of the whole lines that logs have grown by.

The offset of the stream is how many bytes of each file are done, always up to the end of a line; a line that
is still being written waits for the rest of it. A batch is byte ranges of the grown part, read by as many tasks,
so no line is read twice and a log that grows fast is split. Files are opened by their own file system, local or
remote, through pyarrow. With a ``state`` folder an offset is the name of a list of the files there, and a task's
ranges are in a file of that folder, so neither Spark nor its checkpoint holds a word for each file.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import sha256
from uuid import uuid4

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "file string, at long, line string"
#: Bytes of one task's range, and of one look back for the end of the last whole line.
SPLIT, LOOK = 64 << 20, 1 << 16
#: Bytes that a task reads at once.
BLOCK = 1 << 20
#: Lists of finished batches that are kept, twice as many as Spark keeps offsets of by default.
LISTS = 200


@dataclass
class Range:
    """Lines of ``file`` that begin at ``low`` or later and before ``high``; ``first`` says that one begins at ``low``."""

    file: str
    low: int
    high: int
    first: bool


@dataclass
class Ranges(InputPartition):
    """What one task reads: part of a file, or many small files."""

    ranges: list[Range]


def packs(ranges: Iterable[Range], size: int) -> Iterator[list[Range]]:
    """Ranges in order, as many together as ``size`` bytes hold."""
    task, held = [], 0
    for part in ranges:
        if task and held + part.high - part.low > size:
            yield task
            task, held = [], 0
        task.append(part)
        held += part.high - part.low
    if task:
        yield task


def packed(ranges: list[Range], size: int) -> list[Ranges]:
    """Ranges in order, as many to a task as ``size`` bytes hold."""
    return [Ranges(task) for task in packs(ranges, size)]


def whole_lines(size: int, read, done: int) -> int:
    """Bytes up to the last line break after ``done``, looked for from the end."""
    high = size
    while high > done:
        low = max(done, high - LOOK)
        at = read(low, high - low).rfind(b"\n")
        if at >= 0:
            return low + at + 1
        high = low
    return done


def lines_of(handle: pa.NativeFile, low: int, high: int, first: bool) -> Iterator[tuple[int, bytes]]:
    """Place and bytes of each line that begins in a range; the last one may end beyond it."""
    at = low if first else low - 1  # a line begins at ``low`` if the byte before ends one
    handle.seek(at)
    rest, skip = b"", not first
    while at < high:
        block = handle.read(BLOCK)
        if not block:
            return
        *lines, rest = (rest + block).split(b"\n")
        for line in lines:
            if not skip:
                yield at, line
            skip = False
            at += len(line) + 1
            if at >= high:
                return


def _batch(rows: list[tuple[str, int, str]]) -> pa.RecordBatch:
    files, places, lines = zip(*rows)
    return pa.record_batch([pa.array(files, pa.string()), pa.array(places, pa.int64()), pa.array(lines, pa.string())], ["file", "at", "line"])


class TailReader(DataSourceStreamReader):
    """Reads what files below a folder, whose names match, have grown by."""

    def __init__(self, path: str, pattern: str, split: int, tasks: int = 1):
        self.path, self.pattern, self.split, self.tasks = path, re.compile(pattern), split, tasks
        self.known: dict[str, int] = {}

    def files(self) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
        system, root = fs.FileSystem.from_uri(self.path)
        found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        return system, [f for f in found if f.is_file and self.pattern.search(f.path)]

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Whole lines of each file; of a file that has not grown nothing is read."""
        system, found = self.files()
        for info in found:
            done = self.known.get(info.path, 0)
            if info.size > done:
                with system.open_input_file(info.path) as handle:
                    self.known[info.path] = whole_lines(info.size, lambda low, n, h=handle: h.read_at(n, low), done)
        return dict(self.known)

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        """Byte ranges of at most ``split`` bytes, small ones together, for ``tasks`` tasks if there is that much."""
        self.known = {f: max(n, end.get(f, 0)) for f, n in {**end, **self.known}.items()}  # after a restart, what is planned is known
        grown = sorted((file, start.get(file, 0), high) for file, high in end.items() if high > start.get(file, 0))
        size = max(1, min(self.split, -(-sum(high - low for _, low, high in grown) // self.tasks)))
        return packed([Range(f, at, min(at + size, high), at == low) for f, low, high in grown for at in range(low, high, size)], size)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        return self.read_ranges(partition.ranges)

    def read_ranges(self, ranges: Iterable[Range]) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(self.path)
        rows, size = [], 0
        for part in ranges:
            with system.open_input_file(part.file) as handle:
                for at, line in lines_of(handle, part.low, part.high, part.first):
                    rows.append((part.file, at, line.decode("utf-8", "replace").removesuffix("\r")))
                    size += len(line)
                    if len(rows) == 10_000 or size > 4 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
        if rows:
            yield _batch(rows)

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


@dataclass
class Planned(InputPartition):
    """What one task reads: the ranges in a file."""

    plan: str


class ListedTailReader(TailReader):
    """The same, with what is done of each file listed in files below ``state``; an offset is ``{"list": <file>}``.

    Lists are sorted by name and read side by side, line by line: the process holds a number for each file at most,
    and the driver's JVM a name for each batch.
    """

    def __init__(self, path: str, pattern: str, split: int, tasks: int, state: str):
        super().__init__(path, pattern, split, tasks)
        self.state, self.last, self.plans, self.done = state.rstrip("/"), None, {}, []

    def latestOffset(self) -> dict:
        """The list of now, a new one if files have grown."""
        system, root = fs.FileSystem.from_uri(self.path)
        grown = self.last is None
        for path, size in sizes(system, root):
            done = self.known.get(path, 0)
            if size > done and self.pattern.search(path):
                with system.open_input_file(path) as handle:
                    whole = whole_lines(size, lambda low, n, h=handle: h.read_at(n, low), done)
                if whole > done:
                    self.known[path], grown = whole, True
        if grown:
            lines, told = [json.dumps([path, self.known[path]]) for path in sorted(self.known)], sha256()
            for line in lines:
                told.update(line.encode())
            self.last = f"{self.state}/{told.hexdigest()}.list"  # the same list has the same name after a restart
            _write_lines(self.last, lines)
        return {"list": self.last}

    def partitions(self, start: dict, end: dict) -> list[Planned]:
        """Byte ranges as :meth:`TailReader.partitions` deals them, written to a file for each task."""
        if self.last is None:  # after a restart, what is planned is known
            self.known, self.last = dict(_done(end)), end.get("list")
        total = sum(high - low for _, low, high in self.grown(start, end))
        size = max(1, min(self.split, -(-total // self.tasks)))
        ranges = (Range(f, at, min(at + size, high), at == low) for f, low, high in self.grown(start, end) for at in range(low, high, size))
        plans, folder = [], f"{self.state}/plan-{uuid4().hex}"
        self.plans.setdefault(end.get("list"), []).append(folder)
        for task in packs(ranges, size):
            plans.append(Planned(f"{folder}/{len(plans)}"))
            _write_lines(plans[-1].plan, (json.dumps([r.file, r.low, r.high, r.first]) for r in task))
        return plans

    def commit(self, end: dict) -> None:
        """A finished batch needs its plan no more, and Spark's log forgets all but the last lists."""
        system, _ = fs.FileSystem.from_uri(self.state)
        for folder in self.plans.pop(end.get("list"), []):
            path = fs.FileSystem.from_uri(folder)[1]
            if system.get_file_info(path).type == fs.FileType.Directory:
                system.delete_dir(path)
        if end.get("list") not in self.done:
            self.done.append(end.get("list"))
        if len(self.done) > LISTS:
            path = fs.FileSystem.from_uri(self.done.pop(0))[1]
            if system.get_file_info(path).is_file:
                system.delete_file(path)

    def grown(self, start: dict, end: dict) -> Iterator[tuple[str, int, int]]:
        """``file, low, high`` of what was added between two offsets; both lists ascend by file, and none leaves a list."""
        before = _done(start)
        file, done = next(before, (None, 0))
        for path, high in _done(end):
            while file is not None and file < path:
                file, done = next(before, (None, 0))
            low = done if file == path else 0
            if high > low:
                yield path, low, high

    def read(self, partition: Planned) -> Iterator[pa.RecordBatch]:
        return self.read_ranges(Range(*json.loads(line)) for line in _read_lines(partition.plan))


def sizes(system: fs.FileSystem, root: str) -> Iterator[tuple[str, int]]:
    """Path and size of the files below a folder; on a local disk one folder after the other."""
    if not isinstance(system, fs.LocalFileSystem):
        yield from ((f.path, f.size) for f in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)) if f.is_file)
        return
    try:
        entries = os.scandir(root)
    except FileNotFoundError:
        return
    with entries:
        for entry in entries:
            if entry.is_dir():
                yield from sizes(system, entry.path)
            elif entry.is_file():
                yield entry.path, entry.stat().st_size


def _write_lines(file: str, lines: Iterator[str]) -> None:
    system, path = fs.FileSystem.from_uri(file)
    system.create_dir(path.rpartition("/")[0])
    with system.open_output_stream(path, compression=None) as out:
        for line in lines:
            out.write(f"{line}\n".encode())


def _read_lines(file: str) -> Iterator[bytes]:
    system, path = fs.FileSystem.from_uri(file)
    with system.open_input_stream(path, compression=None) as handle:
        rest = b""
        while block := handle.read(BLOCK):
            *lines, rest = (rest + block).split(b"\n")
            yield from lines


def _done(offset: dict) -> Iterator[tuple[str, int]]:
    """File and bytes done, in the list that an offset names; the first offset names none."""
    return (tuple(json.loads(line)) for line in _read_lines(offset["list"])) if offset.get("list") else iter(())


class GrowingLogs(DataSource):
    """``spark.readStream.format("growing_logs")`` with the options ``path``, ``pattern``, ``split``, ``tasks`` and perhaps ``state``."""

    @classmethod
    def name(cls) -> str:
        return "growing_logs"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        options = self.options
        told = options["path"], options.get("pattern", "."), int(options.get("split", SPLIT)), int(options.get("tasks", 1))
        return ListedTailReader(*told, options["state"]) if options.get("state") else TailReader(*told)


def tail_lines(spark: SparkSession, path: str, pattern: str = r"\.json$", split: int = SPLIT, state: str | None = None) -> DataFrame:
    """``(file, at, line)`` of the lines that files below ``path`` grow by, as a stream.

    ``path`` is an absolute folder or a URI, ``pattern`` a regular expression over the files' paths, ``at`` the
    place of a line's first byte: it orders a file's lines, whatever batch they come in. Files may be appended to
    and added, not changed or cut. A restart goes on at the checkpoint's offset. For very many files name a ``state``
    folder that lasts as long as the checkpoint, and that executors reach: offsets are lists there, else each names all files.
    """
    spark.dataSource.register(GrowingLogs)
    reader = spark.readStream.format("growing_logs").option("path", path).option("pattern", pattern).option("split", str(split))
    reader = reader.option("state", state) if state else reader
    return reader.option("tasks", str(spark.sparkContext.defaultParallelism)).load()
