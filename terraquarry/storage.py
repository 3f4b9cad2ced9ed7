"""Intermediate tables in the folder that all executors share: what is used twice is computed once, and survives lost executors."""

from __future__ import annotations

import atexit
import contextlib
import functools
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="terraquarry-core-")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or what setCheckpointDir was given; on a local master without either, a folder of this session's own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    given = spark.sparkContext._jsc.sc().getCheckpointDir()
    if named or given.isDefined():
        return named or given.get()
    if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        return _own_folder()
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # what is gone, or belongs to a session that has ended, stays as it is
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


_ROOTS: set[str] = set()


def stored(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` written to the shared folder and read back; it goes when the driver ends, or by ``release``."""
    spark = frame.sparkSession
    root = f"{shared_folder(spark).rstrip('/')}/terraquarry-core/{spark.sparkContext.applicationId}"
    if root not in _ROOTS:
        _ROOTS.add(root)
        atexit.register(_delete, spark, root)
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    back = spark.read.schema(frame.schema).parquet(path)
    back._stored_at = path
    return back


def release(*frames: DataFrame | None) -> None:
    """Delete stored tables that nothing reads any more."""
    for frame in frames:
        path = getattr(frame, "_stored_at", None)
        if path:
            _delete(frame.sparkSession, path)
