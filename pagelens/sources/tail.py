"""Follow growing, rotating log files as a stream.

Spark's file source takes a file once and never looks at it again. This source keeps an offset per file instead: the
byte behind the last whole line that was read. A file is known by its first line, not by its name, so a log that is
rotated (``rag_x.log`` becomes ``rag_x.log.1``) goes on where it was, and the new file under the old name begins at zero.
Offsets are Spark's own: they are logged with the query's checkpoint, and a restarted query reads no line twice.

Files are reached by ``pyarrow.fs``, so a folder may be local, on a mounted share, or any URI that Arrow knows. It must be the
same for the driver, which lists it, and for the executors, which read ranges of it.
"""

from __future__ import annotations

import fnmatch
import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as afs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "file string, start bigint, value string"
# Bytes of one file that a task reads: a long backlog is read by many tasks.
RANGE_BYTES = 64 << 20
BLOCK = 1 << 20
BATCH_LINES = 8192


@dataclass(frozen=True)
class LogFile:
    """A file as it lies now: the ``key`` survives rotation, ``name`` is that of the current log it belongs to."""

    key: str
    name: str
    path: str
    size: int


@dataclass
class LineRange(InputPartition):
    """Lines of a file that start in [begin, end)."""

    key: str
    begin: int
    end: int


def _position_after_newline(file, begin: int, limit: int) -> int | None:
    """The byte behind the first newline at or after ``begin``, if it lies before ``limit``."""
    at = begin
    while at < limit:
        block = file.read_at(min(BLOCK, limit - at), at)
        found = block.find(b"\n")
        if found >= 0:
            return at + found + 1
        if not block:
            return None
        at += len(block)
    return None


def _behind_last_newline(file, size: int) -> int:
    """The end of the last whole line; a line still being written does not count."""
    end = size
    while end > 0:
        begin = max(0, end - BLOCK)
        found = file.read_at(end - begin, begin).rfind(b"\n")
        if found >= 0:
            return begin + found + 1
        end = begin
    return 0


def _rotation(name: str) -> tuple[str, int]:
    """(current name, how often rotated): ``a.log`` is (a.log, 0), ``a.log.2`` is (a.log, 2)."""
    stem, _, suffix = name.rpartition(".")
    return (stem, int(suffix)) if stem and suffix.isdigit() else (name, 0)


def list_logs(path: str, glob: str) -> list[LogFile]:
    """Every current and rotated log in the folder that has a whole first line. Of several files of one log with equal first
    lines the oldest comes first."""
    system, folder = afs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (afs.LocalFileSystem(), path)
    found = []
    for info in system.get_file_info(afs.FileSelector(folder, allow_not_found=True)):
        name, age = _rotation(info.base_name)
        if info.is_file and info.size and fnmatch.fnmatch(name, glob):
            found.append((name, -age, info))
    files, seen = [], {}
    for name, _, info in sorted(found, key=lambda f: f[:2]):
        try:
            with system.open_input_file(info.path) as file:
                end = _position_after_newline(file, 0, info.size)
                if end is None:
                    continue
                first = hashlib.sha256(file.read_at(end, 0)).hexdigest()[:16]
        except FileNotFoundError:  # rotated while listing; the next trigger sees it
            continue
        nth = seen[name, first] = seen.get((name, first), -1) + 1
        files.append(LogFile(f"{name}/{first}/{nth}", name, info.path, info.size))
    return files


class TailReader(DataSourceStreamReader):
    def __init__(self, path: str, glob: str, range_bytes: int, lost: str):
        self.path, self.glob, self.range_bytes, self.lost = path, glob, range_bytes, lost

    def _system(self):
        return afs.FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith("file:") else afs.LocalFileSystem()

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self, *_) -> dict:
        out, system = {}, self._system()
        for log in list_logs(self.path, self.glob):
            try:
                with system.open_input_file(log.path) as file:
                    out[log.key] = _behind_last_newline(file, log.size)
            except FileNotFoundError:
                pass
        return out

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        out = []
        for key, stop in sorted(end.items()):
            begin = start.get(key, 0)
            out += [LineRange(key, at, min(at + self.range_bytes, stop)) for at in range(begin, stop, self.range_bytes)]
        return out or [LineRange("", 0, 0)]

    def read(self, partition: LineRange) -> Iterator[pa.RecordBatch]:
        if partition.begin >= partition.end:
            return
        log = next((f for f in list_logs(self.path, self.glob) if f.key == partition.key), None)
        if log is None:
            if self.lost == "ignore":
                return
            raise FileNotFoundError(f"log {partition.key} is gone before its lines were read")
        with self._system().open_input_file(log.path) as file:
            yield from self._lines(file, log, partition)

    def _lines(self, file, log: LogFile, part: LineRange) -> Iterator[pa.RecordBatch]:
        at = part.begin
        if at:  # a line that started before belongs to the range before
            at = _position_after_newline(file, at - 1, log.size)
        rest, starts, values = b"", [], []
        place = at  # of the first byte of ``rest``
        while at is not None and place < part.end and at < log.size:
            block = file.read_at(BLOCK, at)
            if not block:
                break
            at += len(block)
            *whole, rest = (rest + block).split(b"\n")
            for line in whole:
                if place >= part.end:
                    break
                starts.append(place)
                values.append(line.removesuffix(b"\r").decode("utf-8", "replace"))
                place += len(line) + 1
                if len(values) >= BATCH_LINES:
                    yield self._batch(log.name, starts, values)
                    starts, values = [], []
        if values:
            yield self._batch(log.name, starts, values)

    @staticmethod
    def _batch(name: str, starts: list[int], values: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([name] * len(values), pa.string()), pa.array(starts, pa.int64()), pa.array(values, pa.string())],
            ["file", "start", "value"])

    def commit(self, end: dict) -> None:
        pass


class LogTail(DataSource):
    """Options: ``path`` (the folder), ``glob`` (names of current logs), ``rangeBytes``, and ``lost``: what to do if a file is
    gone before its lines were read, ``fail`` or ``ignore``."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        # Option names come in any case.
        options = {k.lower(): v for k, v in self.options.items()}
        return TailReader(options["path"], options.get("glob", "*.log"), int(options.get("rangebytes", RANGE_BYTES)),
                          options.get("lost", "fail"))


def tail_logs(spark: SparkSession, path: str, glob: str = "rag_*.log", **options: str | int) -> DataFrame:
    """(file, start, value): lines of all logs in ``path`` as they are written, ``start`` the byte of the line in its file.

    ``file`` is the current log's name for rotated files as well. Empty lines are lines; a last line without newline waits
    until it has one. Bytes that are no UTF-8 are replaced.
    """
    spark.dataSource.register(LogTail)
    return spark.readStream.format("log_tail").options(path=path, glob=glob, **options).load()


def write_logs(lines: DataFrame, path: str) -> None:
    """Write (file, line_no, value) to flat logs below ``path``, one per file name, in order of line_no.

    A log is written by one task, line by line, beside its place and moved there when it is whole, so a task that runs twice
    leaves the same file; a log that is written again with more lines has grown.
    """
    folder = path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        remote = "://" in folder or folder.startswith("file:")
        system, root = afs.FileSystem.from_uri(folder) if remote else (afs.LocalFileSystem(), folder)
        system.create_dir(root, recursive=True)
        name, out, beside, count = None, None, None, 0

        def close() -> list[tuple[str, int]]:
            if out is None:
                return []
            out.close()
            system.move(beside, f"{root}/{name}")
            return [(name, count)]

        done: list[tuple[str, int]] = []
        for batch in batches:
            for file, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if file != name:
                    done += close()
                    name, count, beside = file, 0, f"{root}/.{file}-{uuid.uuid4().hex}"
                    out = system.open_output_stream(beside)
                out.write((value or "").encode() + b"\n")
                count += 1
        done += close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([n for n, _ in done], pa.string()), pa.array([c for _, c in done], pa.int64())], ["file", "lines"])

    lines.repartition("file").sortWithinPartitions("file", "line_no").select("file", "value").mapInArrow(
        run, "file string, lines bigint").write.format("noop").mode("overwrite").save()
