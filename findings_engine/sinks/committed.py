"""Files of a run written by executors, all of them or none: the data source ``runfiles``.

Rows say what goes where: ``kind``, ``path`` (under the root) and ``line``. A row of kind ``file`` is a whole file; the lines of kind ``append``
go behind the file at their path, those of kind ``replace`` take its place, both in the order of partitions and of rows in them.

- A task stages what it gets below ``.runs/<run>/`` under a name of its own attempt, so attempts don't meet, and reports that name only.
- The commit first writes a journal, in one step, that names the attempts that count and how long each file to append to was. From
  then on the run is in. Its steps (moves, appends, replacements) follow; each can be done again without harm, so that ``recover`` brings a
  run to its end whose committer died. Before the journal nothing outside ``.runs`` has changed; an aborted run's folder goes.
- ``recover`` also takes away what runs without a journal left. It is to be called where no other run is on its way (behind the lock).

The root may be in any store that pyarrow.fs reads; all executors have to reach it. The driver lists and moves files; no row comes to it.
"""

from __future__ import annotations

import json
import os
import posixpath
import uuid
from collections.abc import Iterator
from contextlib import suppress
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs as stores
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

RUNS, SCHEMA = ".runs", "kind string, path string, line string"
#: Bytes copied at a time.
COPIED = 1 << 20


def store_of(root: str) -> tuple[stores.FileSystem, str]:
    if "://" in root or root.startswith("file:"):
        return stores.FileSystem.from_uri(root)
    return stores.LocalFileSystem(), root


def inside(path: str) -> str:
    """The path, if it stays under the root."""
    plain = posixpath.normpath(path)
    if not path or plain.startswith(("/", "..")) or plain.split("/")[0] in (RUNS, "."):
        raise ValueError(f"{path!r} is no path under the root")
    return plain


def size_of(fs: stores.FileSystem, path: str) -> int | None:
    info = fs.get_file_info(path)
    return info.size if info.type == stores.FileType.File else None


def write_whole(fs: stores.FileSystem, path: str, body: bytes) -> None:
    """In one step, by a move."""
    fs.create_dir(posixpath.dirname(path), recursive=True)
    beside = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(beside) as out:
        out.write(body)
    fs.move(beside, path)


def keep_first(fs: stores.FileSystem, path: str, body: bytes) -> None:
    """The body at the path, unless something is there: of several writers the first one's stays."""
    fs.create_dir(posixpath.dirname(path), recursive=True)
    beside = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(beside) as out:
        out.write(body)
    if isinstance(fs, stores.LocalFileSystem):
        with suppress(FileExistsError):
            os.link(beside, path)
        os.unlink(beside)
    elif fs.get_file_info(path).type == stores.FileType.NotFound:
        fs.move(beside, path)
    else:
        fs.delete_file(beside)


@dataclass
class Attempt(WriterCommitMessage):
    """What a task staged: its partition and folder, and the paths that it has lines for, by kind."""

    partition: int
    folder: str
    files: int = 0
    lines: dict[str, list[str]] = field(default_factory=dict)


def _part(kind: str, path: str) -> str:
    """The staged name of the lines for a path."""
    return f"{kind}/{path.replace('%', '%25').replace('/', '%2F')}"


def stage(root: str, run: str, partition: int, batches: Iterator[pa.RecordBatch]) -> Attempt:
    """A task's part."""
    fs, base = store_of(root)
    folder = f"{partition}-{uuid.uuid4().hex}"
    at = f"{base}/{RUNS}/{run}/{folder}"
    attempt, open_parts = Attempt(partition, folder), {}
    try:
        for batch in batches:
            for kind, path, line in zip(*(batch.column(c).to_pylist() for c in ("kind", "path", "line")), strict=True):
                path = inside(path)
                if kind == "file":
                    place = f"{at}/file/{path}"
                    fs.create_dir(posixpath.dirname(place), recursive=True)
                    with fs.open_output_stream(place) as out:
                        out.write((line or "").encode())
                    attempt.files += 1
                elif kind in ("append", "replace"):
                    if (kind, path) not in open_parts:
                        place = f"{at}/{_part(kind, path)}"
                        fs.create_dir(posixpath.dirname(place), recursive=True)
                        open_parts[kind, path] = fs.open_output_stream(place)
                        attempt.lines.setdefault(kind, []).append(path)
                    open_parts[kind, path].write(f"{line or ''}\n".encode())
                else:
                    raise ValueError(f"{kind!r} is no kind of row")
    finally:
        for out in open_parts.values():
            out.close()
    return attempt


def begin(root: str, run: str, attempts: list[Attempt], headers: dict[str, str]) -> dict:
    """Write the journal: from here on the run is in."""
    fs, base = store_of(root)
    attempts = sorted(attempts, key=lambda a: a.partition)
    targets: dict[tuple[str, str], list[str]] = {}
    for a in attempts:
        for kind, paths in a.lines.items():
            for path in paths:
                targets.setdefault((kind, path), []).append(f"{a.folder}/{_part(kind, path)}")
    if twice := {p for _, p in targets if sum(path == p for _, path in targets) > 1}:
        raise ValueError(f"{sorted(twice)} would be appended to and replaced")
    lines = [{"kind": kind, "path": path, "before": size_of(fs, f"{base}/{path}"), "header": headers.get(path), "parts": parts} for (kind, path), parts in sorted(targets.items())]
    journal = {"run": run, "files": [a.folder for a in attempts if a.files], "lines": lines}
    write_whole(fs, f"{base}/{RUNS}/{run}.json", json.dumps(journal).encode())
    return journal


def _copy(fs: stores.FileSystem, source: str, out, most: int | None = None) -> None:
    with fs.open_input_stream(source) as body:
        left = most
        while left != 0 and (some := body.read(COPIED if left is None else min(COPIED, left))):
            out.write(some)
            left = None if left is None else left - len(some)


def steps(root: str, journal: dict) -> Iterator[str]:
    """Bring a run to its end, step by step; every step leaves what it has done already as it is."""
    fs, base = store_of(root)
    staged = f"{base}/{RUNS}/{journal['run']}"
    for folder in journal["files"]:
        own = f"{staged}/{folder}/file"
        for info in fs.get_file_info(stores.FileSelector(own, recursive=True, allow_not_found=True)):
            if info.type == stores.FileType.File:
                place = f"{base}/{posixpath.relpath(info.path, own)}"
                fs.create_dir(posixpath.dirname(place), recursive=True)
                fs.move(info.path, place)
                yield place
    for x in journal["lines"]:
        place, before = f"{base}/{x['path']}", x["before"]
        fs.create_dir(posixpath.dirname(place), recursive=True)
        head = f"{x['header']}\n".encode() if x["header"] and (before is None or x["kind"] == "replace") else b""
        if x["kind"] == "append" and before is not None and isinstance(fs, stores.LocalFileSystem):
            with open(place, "r+b") as file:  # what an earlier try appended goes first
                file.truncate(before)
            with fs.open_append_stream(place) as out:
                for part in x["parts"]:
                    _copy(fs, f"{staged}/{part}", out)
        else:
            beside = f"{place}.{journal['run']}.tmp"
            with fs.open_output_stream(beside) as out:
                out.write(head)
                if x["kind"] == "append" and before:
                    _copy(fs, place, out, before)
                for part in x["parts"]:
                    _copy(fs, f"{staged}/{part}", out)
            fs.move(beside, place)
        yield place
    # the journal goes before what it needs
    fs.delete_file(f"{base}/{RUNS}/{journal['run']}.json")
    yield "journal"
    if fs.get_file_info(staged).type == stores.FileType.Directory:
        fs.delete_dir(staged)


def recover(root: str) -> list[str]:
    """Bring committed runs to their end and take away the rest of others; the names of the former. No other run may be on its way."""
    fs, base = store_of(root)
    done = []
    for info in sorted(fs.get_file_info(stores.FileSelector(f"{base}/{RUNS}", allow_not_found=True)), key=lambda i: i.path):
        if info.path.endswith(".json"):
            with fs.open_input_stream(info.path) as body:
                journal = json.loads(body.read())
            for _ in steps(root, journal):
                pass
            done.append(journal["run"])
    for info in fs.get_file_info(stores.FileSelector(f"{base}/{RUNS}", allow_not_found=True)):
        fs.delete_dir(info.path) if info.type == stores.FileType.Directory else fs.delete_file(info.path)
    return done


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.root, self.run, self.headers = options["root"], options["run"], json.loads(options.get("headers", "{}"))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Attempt:
        from pyspark import TaskContext

        return stage(self.root, self.run, TaskContext.get().partitionId(), iterator)

    def steps(self, messages: list[Attempt | None]) -> Iterator[str]:
        yield from steps(self.root, begin(self.root, self.run, [m for m in messages if m], self.headers))

    def commit(self, messages: list[Attempt | None]) -> None:
        for _ in self.steps(messages):
            pass

    def abort(self, messages: list[Attempt | None]) -> None:
        fs, base = store_of(self.root)
        at = f"{base}/{RUNS}/{self.run}"
        # a run whose journal is written is in; recover brings it to its end
        if size_of(fs, f"{at}.json") is None and fs.get_file_info(at).type == stores.FileType.Directory:
            fs.delete_dir(at)


class RunFiles(DataSource):
    """Options: ``root``, ``run`` (a name that no other run has), ``headers`` (JSON: path to the first line of a new file)."""

    @classmethod
    def name(cls) -> str:
        return "runfiles"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options)


def publish(rows: DataFrame, root: str, run: str, order: list[str], headers: dict[str, str] | None = None, source: type[RunFiles] = RunFiles) -> None:
    """Write ``rows`` (kind, path, line and the columns of their order) as one run. An empty table leaves no trace."""
    spark = rows.sparkSession
    spark.dataSource.register(source)
    place = ["kind", "path", *order]
    sorted_rows = rows.repartitionByRange(*place).sortWithinPartitions(*place).select("kind", "path", F.coalesce("line", F.lit("")).alias("line"))
    sorted_rows.write.format(source.name()).option("root", root).option("run", run).option("headers", json.dumps(headers or {})).mode("append").save()


def lines(rows: DataFrame, kind: str, path: str, columns: tuple[str, ...], order: list[str]) -> DataFrame:
    """Rows for ``publish`` of the table's cells, joined by tabs. Tabs and line ends within cells become blanks."""
    cell = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\t\r\n]", " ")
    return rows.select(F.lit(kind).alias("kind"), F.lit(path).alias("path"), *order, F.concat_ws("\t", *map(cell, columns)).alias("line"))
