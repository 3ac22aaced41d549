"""Folders that the driver and all executors share, for tables and checkpoints that cut a plan in two."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``.

    Where that isn't set, a local session (as in tests) gets a folder of its machine; on a cluster it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` as a table in the shared folder: computed once, however often they are read afterwards."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Folder:
    """Directories below a path, by Hadoop's file system, whichever the path belongs to."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.path = path
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def make(self) -> None:
        self._fs.mkdirs(self._path(self.path))

    def directories(self) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(self.path)) if s.isDirectory()]

    def take(self, source: str, name: str) -> None:
        """Moves the directory ``source`` to ``name`` below the path; its files appear at once."""
        if not self._fs.rename(self._path(source), self._path(f"{self.path}/{name}")):
            raise OSError(f"{source} can't be moved to {self.path}")
