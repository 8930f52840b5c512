"""Intermediate tables in the folder that driver and executors share.

A table cuts lineage durably: it survives a lost executor, so the shuffle files of the query that wrote
it are removed with that query.  The folder is the session's ``spark.checkpoint.dir``; where a session has
none (tests, one machine) a local one is made.  What an operator's result still reads stays until the
driver's process ends.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _leave(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # a session that was stopped before has no way to its folder
        _delete(spark, path)


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession):
    """Queries run inside leave no shuffle files behind; for those whose rows are written."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="jointspark-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return "file://" + _local[0]


class Workspace:
    """Tables of one operator call; :meth:`drop` removes those that its result no longer reads."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base = spark, f"{shared_folder(spark)}/ws-{uuid.uuid4().hex}"
        atexit.register(_leave, spark, self.base)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}-{uuid.uuid4().hex[:8]}"
        with shuffles_removed(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._jointspark_path = path
        return out

    def split(self, df: DataFrame, name: str, column: str, n: int) -> list[DataFrame]:
        """Tables of the rows whose ``column`` is 0 to n - 1, without it, written together and dropped each on its own."""
        path = f"{self.base}/{name}-{uuid.uuid4().hex[:8]}"
        with shuffles_removed(self.spark):
            df.write.option("compression", "zstd").partitionBy(column).parquet(path)
        out = []
        for k in range(n):
            own = f"{path}/{column}={k}"
            p = self.spark._jvm.org.apache.hadoop.fs.Path(own)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(p)
            # Without basePath the folder's name would be read as a column.
            table = self.spark.read.option("basePath", own).schema(df.drop(column).schema).parquet(own)
            table._jointspark_path = own
            out.append(table)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            path = getattr(table, "_jointspark_path", None)
            if path:
                _delete(self.spark, path)
