"""Spark's access to paged files: a data source "paged" over byte ranges of files.

A task takes the row groups that begin in its ranges (about TASK bytes; small files share a
task), reads each file's footer itself, and skips the groups and pages that the filters rule out.
Columns are pruned through the option "columns", as Spark doesn't push projections to
Python sources. Filters come through the option "filters", or from Spark itself where read()
finds the session with spark.sql.python.filterPushdown.enabled; without it Spark refuses readers that take
filters, so such a session gets one that doesn't. Files are opened by the file system of their path,
so every executor must reach it.

A folder that write() made has a manifest: the files that one job wrote, put in place when the job
has ended. Files that it doesn't name are never read; a folder without one is read whole.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    Not,
)
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

from tidewater.shipping import ship
from tidewater.sources.paged_format import PagedFile, encode

#: Bytes of files that one task reads, about; and the name of a folder's list of files.
TASK, MANIFEST = 128 << 20, "_manifest"
#: The setting under which Spark gives Python sources its filters; off unless a session sets it.
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
_OPS = {EqualTo: "EQ", LessThan: "LT", LessThanOrEqual: "LE", GreaterThan: "GT", GreaterThanOrEqual: "GE"}


def _open(path: str):
    system, inner = pafs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))
    return system, inner


def list_files(paths: Sequence[str]) -> list[tuple[str, int]]:
    """Files of the paths and their sizes: those that a folder's manifest names, or all *.paged below it."""
    found = []
    for path in paths:
        system, inner = _open(path)
        info = system.get_file_info(inner)
        if info.type == pafs.FileType.Directory:
            prefix = path.rstrip("/")
            names = _manifest(system, inner)
            below = system.get_file_info(pafs.FileSelector(inner, recursive=names is None))
            found += sorted(
                (prefix + f.path[len(inner.rstrip("/")) :], f.size)
                for f in below
                if f.type == pafs.FileType.File and (f.path.endswith(".paged") if names is None else f.base_name in names)
            )
        elif info.type == pafs.FileType.File:
            found.append((path, info.size))
        else:
            raise FileNotFoundError(path)
    return found


def _manifest(system, folder: str) -> set[str] | None:
    place = f"{folder.rstrip('/')}/{MANIFEST}"
    if system.get_file_info(place).type != pafs.FileType.File:
        return None
    with system.open_input_file(place) as source:
        return set(source.read().decode().split())


def open_file(path: str) -> PagedFile:
    system, inner = _open(path)
    return PagedFile(system.open_input_file(inner))


class Ranges(InputPartition):
    """Byte ranges of files: [(path, from, to)]."""

    def __init__(self, ranges: list[tuple[str, int, int]]):
        super().__init__(ranges)


class PagedReader(DataSourceReader):
    def __init__(self, files: list[tuple[str, int]], columns: list[str], filters: list, task_bytes: int):
        self.files, self.columns, self.filters, self.task_bytes = files, columns, [tuple(f) for f in filters], task_bytes

    def partitions(self):
        out, open_bytes = [[]], 0
        for path, size in self.files:
            for begin in range(0, size, self.task_bytes):
                end = min(size, begin + self.task_bytes)
                if open_bytes and open_bytes + end - begin > self.task_bytes:
                    out.append([])
                    open_bytes = 0
                out[-1].append((path, begin, end))
                open_bytes += end - begin
        return [Ranges(x) for x in out]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        for path, begin, end in partition.value:
            file = open_file(path)
            for n in range(len(file.groups)):
                if begin <= file.place(n) < end:
                    yield from file.read_group(n, self.columns, self.filters).to_batches()


class PushedReader(PagedReader):
    """A reader that Spark gives its filters too."""

    def pushFilters(self, filters):  # noqa: N802  Spark's name
        for f in filters:
            inner = f.child if isinstance(f, Not) else f
            op = "NE" if isinstance(f, Not) and isinstance(inner, EqualTo) else None if isinstance(f, Not) else _OPS.get(type(f))
            if op and len(inner.attribute) == 1:
                self.filters.append((inner.attribute[0], op, inner.value))
            yield f  # Spark compares again, which costs little on rows that are left


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def _files(self) -> list[tuple[str, int]]:
        return list_files(self.options["path"].split(","))

    def _columns(self) -> list[str]:
        return [c for c in self.options.get("columns", "").split(",") if c]

    def schema(self) -> StructType:
        files = self._files()
        if not files:
            raise ValueError("no paged file")
        schema = open_file(files[0][0]).schema()
        return from_arrow_schema(pa.schema([schema.field(c) for c in self._columns()]) if self._columns() else schema)

    def reader(self, schema: StructType) -> PagedReader:
        made = PushedReader if self.options.get("pushed") == "true" else PagedReader
        return made(self._files(), self._columns() or schema.names, json.loads(self.options.get("filters", "[]")), int(self.options.get("task_bytes", TASK)))


def read(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str] = (), filters: Sequence[tuple[str, str, object]] = (), task_bytes: int = TASK) -> DataFrame:
    """The rows that pass all filters (column, EQ NE LT LE GT GE, constant)."""
    ship(spark)
    spark.dataSource.register(PagedSource)
    path = paths if isinstance(paths, str) else ",".join(paths)
    pushed = spark.conf.get(PUSHDOWN, "false").lower()
    options = {"path": path, "columns": ",".join(columns), "filters": json.dumps([list(f) for f in filters]), "task_bytes": str(task_bytes), "pushed": pushed}
    return spark.read.format("paged").options(**options).load()


def write(df: DataFrame, path: str, row_group: int = 1024, page: int = 256, file_rows: int = 1 << 20) -> int:
    """Replaces a directory of files, one or more a partition, written in parallel; returns their number.

    The files become the directory's when the manifest names them, after the last one is whole.
    A job that fails leaves the directory as it was, but for files that no manifest names;
    the next job that ends well removes them.
    """
    ship(df.sparkSession)
    system, root = _open(path)
    system.create_dir(root, recursive=True)
    if _manifest(system, root) is None:  # from now on a part counts only if a manifest names it
        whole = [f.base_name for f in system.get_file_info(pafs.FileSelector(root)) if f.is_file and f.base_name.endswith(".paged")]
        _put_manifest(system, root, whole)

    def run(batches):
        system, root = _open(path)
        held, rows = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= file_rows:
                yield _store(system, root, held, row_group, page)
                held, rows = [], 0
        if held:
            yield _store(system, root, held, row_group, page)

    names = {r.file for r in df.mapInArrow(run, "file string").collect()}
    _put_manifest(system, root, names)
    for f in system.get_file_info(pafs.FileSelector(root)):
        if f.is_file and f.base_name.endswith(".paged") and f.base_name not in names:
            system.delete_file(f.path)
    return len(names)


def _put_manifest(system, root: str, names) -> None:
    """Written under another name and moved, so that a reader sees the old one or the new one."""
    with system.open_output_stream(f"{root}/.{MANIFEST}", compression=None) as sink:
        sink.write("\n".join(sorted(names)).encode())
    system.move(f"{root}/.{MANIFEST}", f"{root}/{MANIFEST}")


def _store(system, root: str, held: list[pa.RecordBatch], row_group: int, page: int) -> pa.RecordBatch:
    name = f"part-{uuid.uuid4().hex}.paged"
    with system.open_output_stream(f"{root}/{name}", compression=None) as sink:
        sink.write(encode(pa.Table.from_batches(held), row_group, page))
    return pa.RecordBatch.from_arrays([pa.array([name])], ["file"])
