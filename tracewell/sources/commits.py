"""A log of numbered commit records in a folder: create-only, so of two writers of one number one wins."""

from __future__ import annotations

import json
import os
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class CommitLog:
    """Records ``0, 1, 2, ...`` as files of one JSON object each, in any file system that Spark's readers reach."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _file(self, number: int) -> Any:
        return self._path(f"{self.folder}/{number:012d}.json")

    def numbers(self) -> list[int]:
        """Numbers of all complete records, in order."""
        if not self._fs.exists(self._path(self.folder)):
            return []
        names = [status.getPath().getName() for status in self._fs.listStatus(self._path(self.folder))]
        return sorted(int(name[:-5]) for name in names if name.endswith(".json") and name[:-5].isdigit())

    def read(self, number: int) -> dict:
        stream = self._fs.open(self._file(number))
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def create(self, number: int, record: dict) -> bool:
        """Write record ``number``; False if there is one already. It appears whole or not at all."""
        target = self._file(number)
        if self._fs.exists(target):
            return False
        staged = self._path(f"{self.folder}/.{number:012d}-{os.urandom(8).hex()}")
        stream = self._fs.create(staged, False)
        stream.write(bytearray(json.dumps(record, sort_keys=True).encode()))
        stream.close()
        renames = self._jvm.org.apache.hadoop.fs.Options.Rename
        modes = self.spark.sparkContext._gateway.new_array(renames, 1)
        modes[0] = renames.NONE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()) \
            if target.toUri().getScheme() else self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            # A rename that never replaces: of two writers one gets an error.
            context.rename(staged, target, modes)
            return True
        except Py4JJavaError as problem:
            self._fs.delete(staged, False)
            if self._fs.exists(target):
                return False
            raise problem

    def latest(self) -> tuple[int, dict] | None:
        numbers = self.numbers()
        return (numbers[-1], self.read(numbers[-1])) if numbers else None

    def remove(self, path: str) -> None:
        """Delete a folder of data that no record names any more."""
        self._fs.delete(self._path(path), True)
