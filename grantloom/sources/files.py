"""Folders in the cluster's shared storage, through Spark's own file systems."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession


def _path(spark: SparkSession, path: str) -> tuple[object, object]:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, system = _path(spark, path)
    return system.exists(where)


def names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if it isn't there."""
    where, system = _path(spark, path)
    return [x.getPath().getName() for x in system.listStatus(where)] if system.exists(where) else []


def committed(spark: SparkSession, path: str) -> bool:
    """Whether the write of a table of files came to its end."""
    return exists(spark, f"{path}/_SUCCESS")


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of files; empty if there is none."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


_roots: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """This application's folder below the one that the cluster names in spark.checkpoint.dir; a temporary one only where that
    is unset and all tasks run on this machine. It goes when the driver ends."""
    application, base = spark.sparkContext.applicationId, spark.conf.get("spark.checkpoint.dir", None)
    if application not in _roots:
        if not base and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = _roots[application] = f"{(base or 'file://' + tempfile.mkdtemp()).rstrip('/')}/stages-{uuid.uuid4().hex[:12]}"

        def clear() -> None:
            with suppress(Exception):  # the session may be gone by then
                where, system = _path(spark, root)
                system.delete(where, True)

        atexit.register(clear)
    return _roots[application]


def saved(df: DataFrame) -> DataFrame:
    """Written once as a table of files and read again: what several results are made of isn't made for each."""
    path = f"{scratch(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
