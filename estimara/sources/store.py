"""Small files of a project on any file system that Spark reaches, and records that several sessions may add at once."""

from __future__ import annotations

import itertools
import json
import os
import time
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_COUNT = itertools.count()


def located(path: str) -> str:
    """A path without a scheme is the driver's own."""
    return path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}"


class Store:
    """A folder. A file appears whole or not at all: it is written beside its place and then renamed."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, located(folder).rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._files.setWriteChecksum(False)

    def _at(self, name: str):
        return self._path(f"{self.folder}/{name}")

    def exists(self, name: str) -> bool:
        return self._files.exists(self._at(name))

    def write(self, name: str, text: str) -> None:
        """A new file, or a new text of one."""
        beside = self._at(f"{name.rpartition('/')[0]}/.{uuid.uuid4().hex}.tmp")
        self._files.mkdirs(self._at(name).getParent())
        out = self._files.create(beside, True)
        try:
            out.write(bytearray(text.encode("utf-8")))
        finally:
            out.close()
        if not self._files.rename(beside, self._at(name)):
            self._files.delete(self._at(name), False)  # file systems that don't rename over a file
            self._files.rename(beside, self._at(name))

    def read(self, name: str) -> str:
        source = self._files.open(self._at(name))
        try:
            return bytes(source.readAllBytes()).decode("utf-8")
        finally:
            source.close()

    def names(self, folder: str) -> list[str]:
        """Files of a folder below, by name."""
        at = self._at(folder)
        found = self._files.listStatus(at) if self._files.exists(at) else []
        return sorted(n for n in (f.getPath().getName() for f in found) if not n.startswith("."))

    def append(self, folder: str, record: dict[str, Any]) -> str:
        """A record of its own name, in order of time; in a session, in order of calls. Nobody else writes that name, so no record is lost."""
        name = f"{time.time_ns():020d}-{next(_COUNT):08d}-{uuid.uuid4().hex[:12]}.json"
        self.write(f"{folder}/{name}", json.dumps(record, ensure_ascii=False))
        return name

    def frame(self, folder: str) -> DataFrame:
        """(name, value) of all records, as a table."""
        if not self.names(folder):
            return self.spark.createDataFrame([], "name string, value string")
        texts = self.spark.read.text(f"{self.folder}/{folder}", wholetext=True, pathGlobFilter="*.json")
        return texts.select(F.col("_metadata.file_name").alias("name"), "value")

    def records(self, folder: str) -> list[dict[str, Any]]:
        return [json.loads(r["value"]) for r in self.frame(folder).orderBy("name").collect()]
