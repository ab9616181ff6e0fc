"""Folders as a Spark data source: ``tree`` reads files as rows and writes rows as files, on any file system.

Reading: the driver lists a bounded number of folders near the top; each is a
partition whose task walks it, hidden names included, and gives its files in
Arrow batches of a bounded number of bytes. Writing: each task writes its rows
to their places and says of every row what came of it; one failed file does
not fail the others.

File systems are those of pyarrow (local paths, ``file://``, ``hdfs://``,
``s3://``, ``gs://``, ...).
"""

from __future__ import annotations

import json
import os
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

FOUND = "path string, mtime string, size_bytes bigint"
FORMAT = "tree"
BATCH_BYTES = 32 << 20
BATCH_ROWS = 1000
#: Folders that the driver lists at most before tasks walk the rest.
LISTED = 256


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path in it."""
    if "://" in uri:
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), os.path.abspath(uri)


@dataclass
class Folder(InputPartition):
    path: str
    deep: bool

    def __init__(self, path: str, deep: bool):
        super().__init__(path)
        self.path, self.deep = path, deep


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.contents = options.get("contents", "true") == "true"
        self.skip = json.loads(options.get("skip", "[]"))

    def _skipped(self, relative: str) -> bool:
        return any(relative == s or relative.startswith(s + "/") for s in self.skip)

    def partitions(self) -> list[Folder]:
        """Folders to walk. The largest level with at most ``LISTED`` folders is listed here; above it, folders give their own files only."""
        fs, root = opened(self.root)
        level, out = [root], []
        while level and len(level) + len(out) < LISTED:
            below = []
            for folder in level:
                for x in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=folder != root)):
                    if x.type == pafs.FileType.Directory and not self._skipped(x.path[len(root) :].strip("/")):
                        below.append(x.path)
                if len(below) + len(out) + len(level) > 2 * LISTED:
                    return out + [Folder(p, True) for p in level]
            out += [Folder(p, False) for p in level]
            level = below
        return out + [Folder(p, True) for p in level]

    def _walk(self, fs: pafs.FileSystem, root: str, folder: Folder) -> Iterator[pafs.FileInfo]:
        waiting = [folder.path]
        while waiting:
            for x in fs.get_file_info(pafs.FileSelector(waiting.pop(), allow_not_found=True)):
                if self._skipped(x.path[len(root) :].strip("/")):
                    continue
                if x.type == pafs.FileType.Directory:
                    if folder.deep:
                        waiting.append(x.path)
                elif x.type == pafs.FileType.File:
                    yield x

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        fs, root = opened(self.root)
        rows, held = [], 0

        def batch() -> pa.RecordBatch:
            kinds = [pa.string(), pa.string(), pa.int64(), *([pa.binary()] if self.contents else [])]
            names = ["path", "mtime", "size_bytes", *(["content"] if self.contents else [])]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for x in self._walk(fs, root, partition):
            row = [x.path[len(root) :].strip("/"), x.mtime.strftime("%Y-%m-%dT%H:%M:%S.%fZ") if x.mtime else None, x.size]
            if self.contents:
                if rows and held + x.size > BATCH_BYTES:
                    yield batch()
                    rows, held = [], 0
                try:
                    with fs.open_input_stream(x.path) as f:
                        row.append(f.read())
                except FileNotFoundError:  # gone since it was listed
                    continue
                row[2] = len(row[3])
                held += row[2]
            rows.append(row)
            if len(rows) == BATCH_ROWS:
                yield batch()
                rows, held = [], 0
        if rows:
            yield batch()


@dataclass
class Report(WriterCommitMessage):
    """Where a task's report lies; what it says of each file stays there."""

    path: str
    written: int
    failed: int


class TreeWriter(DataSourceArrowWriter):
    """Rows (path, content) as files below the root; null contents are missing ones.

    What came of each row is a line of JSON in the folder ``report``, which
    the driver only names. A job that fails leaves the files that were written
    whole, and no report.
    """

    def __init__(self, options: dict):
        self.root, self.report = options["path"], options["report"]

    def _one(self, fs: pafs.FileSystem, root: str, path: str | None, content: bytes | None) -> tuple[str, str | None]:
        if content is None:
            return "missing", None
        place = os.path.normpath(f"{root}/{path}")
        if not path or not place.startswith(root.rstrip("/") + "/"):
            return "failed", "the path leads out of the folder"
        try:
            fs.create_dir(os.path.dirname(place), recursive=True)
            half = f"{place}.part"
            with fs.open_output_stream(half) as f:
                f.write(content)
            fs.move(half, place)
        except OSError as e:
            return "failed", str(e).splitlines()[0]
        return "written", None

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Report:
        from pyspark import TaskContext

        fs, root = opened(self.root)
        there, at = opened(self.report)
        there.create_dir(at, recursive=True)
        task = TaskContext.get()
        name = f"{at}/part-{task.partitionId():06d}-{task.taskAttemptId()}.json"
        counts = {"written": 0, "failed": 0, "missing": 0}
        with there.open_output_stream(name) as out:
            for batch in iterator:
                paths = batch.column(batch.schema.get_field_index("path"))
                bodies = batch.column(batch.schema.get_field_index("content"))
                for i in range(batch.num_rows):
                    path = paths[i].as_py()
                    status, error = self._one(fs, root, path, bodies[i].as_py())
                    counts[status] += 1
                    out.write(json.dumps({"path": path, "status": status, "error": error}).encode() + b"\n")
        return Report(name, counts["written"], counts["failed"] + counts["missing"])

    def commit(self, messages: list[Report]) -> None:
        """Reports of attempts that do not count go."""
        there, at = opened(self.report)
        own = {os.path.basename(m.path) for m in messages if m is not None}
        for x in there.get_file_info(pafs.FileSelector(at, allow_not_found=True)):
            if os.path.basename(x.path) not in own:
                there.delete_file(x.path)

    def abort(self, messages: list[Report]) -> None:
        there, at = opened(self.report)
        if there.get_file_info(at).type == pafs.FileType.Directory:
            there.delete_dir(at)


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return FOUND + (", content binary" if self.options.get("contents", "true") == "true" else "")

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> TreeWriter:
        return TreeWriter(dict(self.options))


def registered(spark: SparkSession) -> SparkSession:
    """The session with this source; its classes travel by value, so that workers need not have the package."""
    if not getattr(spark, "_calcstrata_tree", False):
        cloudpickle.register_pickle_by_value(sys.modules[__name__])
        spark.dataSource.register(TreeSource)
        spark._calcstrata_tree = True
    return spark


def read(spark: SparkSession, root: str, contents: bool = True, skip: list[str] = ()) -> DataFrame:
    """path (relative), mtime, size_bytes[, content] of all files below ``root`` but those in folders ``skip``."""
    return registered(spark).read.format(FORMAT).option("contents", str(contents).lower()).option("skip", json.dumps(list(skip))).load(root)


def write(rows: DataFrame, root: str, report: str) -> DataFrame:
    """Write rows (path, content) below ``root``; (path, status, error) of each: written, failed or missing."""
    spark = registered(rows.sparkSession)
    rows.select("path", "content").write.format(FORMAT).mode("append").option("path", root).option("report", report).save()
    return spark.read.schema("path string, status string, error string").json(report if "://" in report else f"file://{os.path.abspath(report)}")
