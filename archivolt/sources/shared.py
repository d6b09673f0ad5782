"""The folder that the driver and the executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a temporary folder, in local runs only: on a cluster every machine would
    write to its own disk, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="archivolt-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return f"file://{_local[0]}"


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call has given."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def delete(spark: SparkSession, folder: str) -> None:
    system, where = _at(spark, folder)
    system.delete(where, True)


def rename(spark: SparkSession, old: str, new: str) -> None:
    system, where = _at(spark, old)
    if not system.rename(where, _at(spark, new)[1]):
        raise OSError(f"{old} can't take the place of {new}")


def exists(spark: SparkSession, path: str) -> bool:
    system, where = _at(spark, path)
    return system.exists(where)


def listed(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder; none where it doesn't exist."""
    system, where = _at(spark, folder)
    return [f.getPath().getName() for f in system.listStatus(where)] if system.exists(where) else []


@contextmanager
def settings(spark: SparkSession, **conf: str) -> Iterator[None]:
    """The session with other settings for a while."""
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


_written: dict[str, SparkSession] = {}


def keep_until_release(spark: SparkSession, path: str) -> None:
    """Has a folder go at the end of the process, or by `release`."""
    _written[path] = spark


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read back: later jobs don't compute it again, and lost executors take nothing along.
    The table goes at the end of the process, or by `release`."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    keep_until_release(spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def release() -> None:
    """Deletes the tables that `written` wrote in this process."""
    while _written:
        path, spark = _written.popitem()
        if spark.sparkContext._jsc is not None:
            delete(spark, path)
