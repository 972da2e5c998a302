"""Shared scratch space for intermediate tables and checkpoints.

Intermediate results are written as tables rather than kept on executors, so that losing an
executor costs one task and not the lineage. The folder is the one the cluster names in
`spark.checkpoint.dir`, or else the session's warehouse: both are shared by driver and executors.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from roomtide.config import child


_scope: ContextVar[str | None] = ContextVar("scratch scope", default=None)


def scratch_root(spark: SparkSession) -> str:
    scope = _scope.get()
    if scope:
        return scope
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        named = child(spark.conf.get("spark.sql.warehouse.dir"), "scratch")
        spark.sparkContext.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path nobody used before."""
    return child(scratch_root(spark), f"{name}-{uuid.uuid4().hex}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written once as a scratch table and read back with its own schema."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def delete(spark: SparkSession, path: str) -> None:
    files, target = _file_system(spark, path)
    files.delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    files, target = _file_system(spark, path)
    return files.exists(target)


def move(spark: SparkSession, path: str, target: str) -> None:
    files, source = _file_system(spark, path)
    if not files.rename(source, spark._jvm.org.apache.hadoop.fs.Path(target)):
        raise OSError(f"{path} could not be renamed to {target}")


def folders(spark: SparkSession, path: str) -> list[str]:
    """The names of the folders in a folder; none if it is not there."""
    files, target = _file_system(spark, path)
    if not files.exists(target):
        return []
    return [f.getPath().getName() for f in files.listStatus(target) if f.isDirectory()]


@contextmanager
def scratch_scope(spark: SparkSession, name: str) -> Iterator[str]:
    """A folder for all scratch tables made inside, deleted at the end.

    Nothing that still reads them may be used after the scope: write results elsewhere first.
    """
    root = scratch_path(spark, name)
    token = _scope.set(root)
    try:
        yield root
    finally:
        _scope.reset(token)
        delete(spark, root)
