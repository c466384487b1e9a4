"""Small files and folders through Hadoop's file systems, so that a warehouse can be on any store that Spark reads."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class FileSystem:
    def __init__(self, spark: SparkSession, root: str):
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._io = jvm.org.apache.commons.io.IOUtils
        self.fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.root = str(self.fs.makeQualified(self._path(root)).toString())

    def exists(self, path: str) -> bool:
        return self.fs.exists(self._path(path))

    def make(self, path: str) -> None:
        self.fs.mkdirs(self._path(path))

    def names(self, path: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(path))) if self.exists(path) else []

    def folders(self, path: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(path)) if s.isDirectory()) if self.exists(path) else []

    def read(self, path: str) -> str:
        stream = self.fs.open(self._path(path))
        try:
            return self._io.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put_new(self, path: str, text: str) -> bool:
        """Write a file whole under a name that nobody holds yet; False if somebody does."""
        aside = f"{path}.{uuid.uuid4().hex}.tmp"
        out = self.fs.create(self._path(aside), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        done = not self.exists(path) and self.fs.rename(self._path(aside), self._path(path))
        if not done:
            self.delete(aside)
        return done

    def move(self, path: str, to: str) -> bool:
        return self.fs.rename(self._path(path), self._path(to))

    def delete(self, path: str) -> None:
        self.fs.delete(self._path(path), True)
