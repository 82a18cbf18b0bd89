"""Folder operations through Hadoop's file systems, so any store that Spark reads works.

Only names are handled here, never data: listing, renaming and deleting folders. Spark's own readers
leave out folders whose names begin with ``_`` or ``.``; staged and retired data lie in such.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import SparkSession

#: The folder name of a null partition value.
NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"


class Folders:
    """The file system that holds ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def names(self, path: str) -> list[str]:
        """Names of the folders in ``path``; none if it doesn't exist."""
        if not self.exists(path):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(path)) if s.isDirectory())

    def move(self, source: str, target: str) -> None:
        parent = self._path(target).getParent()
        self._fs.mkdirs(parent)
        if not self._fs.rename(self._path(source), self._path(target)):
            raise OSError(f"can't move {source} to {target}")

    def make(self, path: str) -> None:
        self._fs.mkdirs(self._path(path))

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)


def partition_folder(column: str, value: str, spark: SparkSession) -> str:
    """``column=value`` as Spark writes it (odd characters escaped)."""
    names = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    return names.getPartitionPathString(column, value)


def partition_value(folder: str) -> str | None:
    """The value in a partition folder's name."""
    value = folder.split("=", 1)[1]
    return None if value == NULL_PARTITION else unquote(value)
