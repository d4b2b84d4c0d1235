"""Durable intermediates in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """A new path under the session's ``spark.checkpoint.dir``.

    Where that is unset and the master is local, as in tests, a temporary folder is made and set;
    on a cluster, whose machines have no such folder in common, that is a RuntimeError.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="rillstone-")
        spark.sparkContext.setCheckpointDir(base)
        spark.conf.set("spark.checkpoint.dir", base)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return f"{files.makeQualified(path).toString().rstrip('/')}/{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder that this module made."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Durable tables made inside are deleted at the end, so nothing that reads them may be used later,
    but for those made with ``outlive``, which belong to the scope around it, if there is one."""
    paths: list[str] = []
    _scopes.append(paths)
    try:
        yield
    finally:
        _scopes.pop()
        for path in paths:
            delete(spark, path)


def durable(df: DataFrame, outlive: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read again: the lineage is cut, and later reads outlive lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    if len(_scopes) > outlive:
        _scopes[-1 - outlive].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
