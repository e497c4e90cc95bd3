"""The few file operations that Spark's readers and writers don't offer, in any store that Spark reaches."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Entry:
    name: str
    path: str
    #: Seconds since it was last changed.
    age: float


class Files:
    """Hadoop's file system of a path."""

    def __init__(self, spark: SparkSession):
        self.path_of = spark._jvm.org.apache.hadoop.fs.Path
        self.conf = spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        own = self.path_of(path)
        return own, own.getFileSystem(self.conf)

    def exists(self, path: str) -> bool:
        own, files = self._at(path)
        return files.exists(own)

    def entries(self, path: str) -> list[Entry]:
        """What lies directly in a folder, by name; nothing if there is no such folder."""
        own, files = self._at(path)
        if not files.exists(own):
            return []
        found = ((s.getPath(), s.getModificationTime()) for s in files.listStatus(own))
        return sorted((Entry(p.getName(), p.toString(), time.time() - t / 1000) for p, t in found), key=lambda e: e.name)

    def create(self, path: str) -> bool:
        """Make an empty file; False if it is there already."""
        own, files = self._at(path)
        return files.createNewFile(own)

    def move(self, path: str, to: str) -> bool:
        own, files = self._at(path)
        return files.rename(own, self.path_of(to))

    def remove(self, path: str) -> bool:
        own, files = self._at(path)
        return files.delete(own, True)
