"""Small files of a store on any file system that Spark reaches, seen from the driver."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


class ConflictError(Exception):
    """Another writer was first."""


class Files:
    """Text files and folders below a root, by Hadoop's file systems; paths are relative to it."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self.root = spark._jvm, str(root).rstrip("/")
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())
        self.local = self._fs.getScheme() == "file"

    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}" if path else self.root)

    def _here(self, path: str) -> str:
        return f"{self.root}/{path}".removeprefix("file://")

    def exists(self, path: str = "") -> bool:
        return self._fs.exists(self._at(path))

    def read(self, path: str) -> str:
        stream = self._fs.open(self._at(path))
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def names(self, path: str = "") -> list[str]:
        """Names in a folder; none if there is no folder."""
        return [s.getPath().getName() for s in self._fs.listStatus(self._at(path))] if self.exists(path) else []

    def make(self, path: str = "") -> None:
        self._fs.mkdirs(self._at(path))

    def delete(self, path: str = "") -> None:
        self._fs.delete(self._at(path), True)

    def _write(self, path: str, text: str) -> None:
        stream = self._fs.create(self._at(path), True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()

    def put(self, path: str, text: str) -> None:
        """Write a file as a whole: readers see the old one or the new one."""
        new = f"{path}-{uuid.uuid4().hex}"
        if self.local:
            with open(self._here(new), "w", encoding="utf-8") as f:
                f.write(text)
            os.replace(self._here(new), self._here(path))
        else:
            self._write(new, text)
            self._fs.delete(self._at(path), False)
            self._fs.rename(self._at(new), self._at(path))

    def put_new(self, path: str, text: str) -> None:
        """Write a file that must not be there yet; ConflictError if it is, and then nothing has changed.

        A finished file takes its name in one step that fails if the name is
        taken: a link on a local disk, else a rename.
        """
        new = f"{path}-{uuid.uuid4().hex}"
        if self.local:
            with open(self._here(new), "w", encoding="utf-8") as f:
                f.write(text)
            try:
                os.link(self._here(new), self._here(path))
            except FileExistsError:
                raise ConflictError(path) from None
            finally:
                os.unlink(self._here(new))
            return
        self._write(new, text)
        if self.exists(path) or not self._fs.rename(self._at(new), self._at(path)):
            self._fs.delete(self._at(new), False)
            raise ConflictError(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``; a session without it (a local test) gets its own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    known = getattr(spark, "_calcstrata_shared", None)
    if known is None:
        known = spark._calcstrata_shared = "file://" + tempfile.mkdtemp(prefix="calcstrata-")
    return known
