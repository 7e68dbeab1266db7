"""Intermediate tables in the folder that all executors share, and their end.

A table that is written and read again cuts a long plan, and survives lost executors. Its shuffle files go as soon as it is
written. Tables that a ``scope`` saw made are deleted when the scope ends; what a returned DataFrame still reads must outlive it.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_scopes: list[list[str]] = []
_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of its own only where a local session (a test) sets none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _local:
        _local[key] = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
    return _local[key]


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What runs inside leaves no shuffle files; only for plans that run once."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """df, computed once: written to the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidemark-{uuid.uuid4().hex}"
    names = [f"c{i}" for i in range(len(df.columns))]
    with shuffles_dropped(spark):
        df.toDF(*names).write.parquet(path)
    for scope_ in _scopes[-1:]:
        scope_.append(path)
    return spark.read.schema(df.toDF(*names).schema).parquet(path).toDF(*df.columns)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def children(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if it is not there."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in files.listStatus(place)) if files.exists(place) else []


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables that cut() wrote inside."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            delete(spark, path)
