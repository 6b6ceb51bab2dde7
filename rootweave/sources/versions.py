"""Small states of a folder, one for every version: what tables it consists of now.

A version is a file that is written aside and renamed to its number once, never over another; so of two writers who
start from the same version one fails and looks again, and one that dies leaves nothing in the way. Such a rename is atomic
on HDFS; a local file system looks first and renames then, and stores without renames need a lock of their own.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has made this version."""


class Versions:
    def __init__(self, spark: SparkSession, folder: str, keep: int = 20) -> None:
        self._hadoop, self._keep = spark._jvm.org.apache.hadoop.fs, keep
        self._text = spark._jvm.org.apache.commons.io.IOUtils.toString
        self._folder = self._hadoop.Path(f"{folder.rstrip('/')}/_versions")
        conf = spark._jsc.hadoopConfiguration()
        self._fs = self._folder.getFileSystem(conf)
        self._fs.mkdirs(self._folder)
        self._context = self._hadoop.FileContext.getFileContext(self._fs.getUri(), conf)
        self._plain = spark.sparkContext._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)

    def _numbers(self) -> list[int]:
        return sorted(int(f.getPath().getName()) for f in self._fs.listStatus(self._folder) if f.getPath().getName().isdigit())

    def _path(self, name: int | str):
        return self._fs.makeQualified(self._hadoop.Path(self._folder, f"{name:012d}" if isinstance(name, int) else name))

    def latest(self) -> tuple[int, dict]:
        """The greatest version and its state; (0, {}) before the first."""
        numbers = self._numbers()
        if not numbers:
            return 0, {}
        stream = self._fs.open(self._path(numbers[-1]))
        try:
            return numbers[-1], json.loads(self._text(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, number: int, state: dict) -> None:
        """Make `state` the version `number`, the next to the one that it was made from."""
        from py4j.protocol import Py4JJavaError

        aside = self._path(f"new-{uuid.uuid4().hex}")
        stream = self._fs.create(aside, True)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        try:
            self._context.rename(aside, self._path(number), self._plain)
        except Py4JJavaError as problem:
            self._fs.delete(aside, False)
            if "FileAlreadyExistsException" in str(problem.java_exception.getClass().getName()):
                raise Conflict(f"version {number}") from problem
            raise
        for old in self._numbers()[: -self._keep]:
            self._fs.delete(self._path(old), False)
