"""Intermediate tables in the folder that all machines of a cluster share.

A written table cuts the lineage and is computed once; a lost executor costs no
more than its running tasks.  Tables that are no longer read are removed, so
the disk holds what the running step needs; what a result still reads, and what a
failure leaves, goes when the application ends.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where none is set, a temporary folder if all runs on one machine, and else an error."""
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if spark.sparkContext.master.split("[")[0] == "local":
        return os.path.join(tempfile.gettempdir(), "fieldstone-tables")
    raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")


class Tables:
    """Tables of one run, by name."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.names: set[str] = set()
        path, fs = self._path("")
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def _path(self, name: str):
        """A path below the folder and its file system."""
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(context._jsc.hadoopConfiguration())

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """df as a table that has been written."""
        df.write.parquet(f"{self.folder}/{name}")
        self.names.add(name)
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        """Remove tables that nothing reads any more."""
        for name in names:
            path, fs = self._path(name)
            fs.delete(path, True)
            self.names.discard(name)

    def drop_others(self, *names: str) -> None:
        """Remove all tables but these."""
        self.drop(*self.names.difference(names))
