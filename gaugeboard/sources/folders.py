"""Folders of a file system that Spark can reach: names, markers, deletion."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Folder:
    """A folder by its path, which need not exist yet."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str = ""):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def child(self, name: str) -> Folder:
        return Folder(self.spark, f"{self.path}/{name}")

    def names(self) -> list[str]:
        """Names of files and folders in it, sorted."""
        fs, path = self._at()
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def has(self, name: str) -> bool:
        fs, path = self._at(name)
        return fs.exists(path)

    def mark(self, name: str) -> None:
        """Create an empty file; one step on file systems and object stores alike."""
        fs, path = self._at(name)
        fs.create(path, True).close()

    def delete(self, name: str) -> None:
        fs, path = self._at(name)
        fs.delete(path, True)

    def fingerprint(self) -> list[tuple[str, int, int]]:
        """(path, bytes, time of change) of every file at or below it, hidden ones left out."""
        fs, path = self._at()
        if not fs.exists(path):
            return []
        found, files = [], fs.listFiles(path, True)
        while files.hasNext():
            file = files.next()
            if not file.getPath().getName().startswith(("_", ".")):
                found.append((file.getPath().toString(), file.getLen(), file.getModificationTime()))
        return sorted(found)
