"""A folder for files that a query writes and reads again, shared by driver and executors."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import SparkSession

_local: list[str] = []


def folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, or below a local one where that is unset (one machine); removed at exit."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="jointspark-files-"))
        base = "file://" + _local[0]
    path = f"{base.rstrip('/')}/files-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # a session that was stopped before has no way to its files
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
