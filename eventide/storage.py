"""Shared intermediate storage for results that several later steps read."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_owner: ContextVar[str | None] = ContextVar("owner", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in `spark.checkpoint.dir`.

    Only a local session without the setting falls back to a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    fallback = tempfile.mkdtemp(prefix="eventide-")
    spark.conf.set("spark.checkpoint.dir", fallback)
    return fallback


def stash(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Cuts the lineage, survives lost executors, keeps column pruning, and gives the planner true
    sizes, so that it alone decides whether a side is small enough to broadcast. Inside a `scope` it
    lives as long as that; else until whoever owns the shared folder clears it.
    """
    path = f"{_owner.get() or shared_dir(df.sparkSession)}/stash-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[str]:
    """A folder that owns all intermediate results made inside and goes with them at the end.

    Frames built on them must be written or collected before the scope ends. Inner scopes have folders
    within the outer one.
    """
    folder = f"{_owner.get() or shared_dir(spark)}/scope-{uuid.uuid4().hex}"
    token = _owner.set(folder)
    try:
        yield folder
    finally:
        _owner.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
