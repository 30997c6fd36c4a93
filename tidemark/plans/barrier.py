"""Points where a plan ends and its rows are kept."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """URI of a new folder in the folder that driver and executors share, ``spark.checkpoint.dir``.

    Only where the session runs on one machine and has no such setting, as in tests, a temporary folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/settled-{uuid.uuid4().hex}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


_open = threading.local()


class Scope:
    """Tables settled inside are deleted at its end.  What has to outlive them is written with ``keep``, or by the caller.

    Scopes belong to a thread and may lie in each other; a table belongs to the innermost one.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folders = spark, []

    def __enter__(self) -> Scope:
        _open.scopes = [*getattr(_open, "scopes", []), self]
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` settled in what lies around this scope."""
        _open.scopes.remove(self)
        try:
            return settled(df)
        finally:
            _open.scopes.append(self)

    def __exit__(self, *error) -> None:
        _open.scopes.remove(self)
        for folder in self.folders:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def settled(df: DataFrame) -> DataFrame:
    """The same rows, computed once and written as Parquet: plans that use them often stay small, and keep their pruning and statistics."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    for scope in getattr(_open, "scopes", [])[-1:]:
        scope.folders.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
