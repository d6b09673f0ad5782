"""Shared helpers of the corpus operators: input normalisation and shared-folder tables."""

from __future__ import annotations

import atexit
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.sources.shared import delete, new_folder

#: The characters of `[\x20\x09-\x0D]`.
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table of the input folder, pruned to `columns`."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone, so extra columns can't clash; a null text becomes empty."""
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


#: Tables written by this process and not yet deleted.
_written: dict[str, SparkSession] = {}


def stored(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """`df` written as a table in the shared folder and read back, which cuts its lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    _written[path] = spark
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def stored_in_buckets(df: DataFrame, name: str, keys: tuple[str, ...], buckets: int) -> DataFrame:
    """As `stored`, as a table bucketed by `keys` and sorted in each bucket: joins by the keys leave it where it is. Rows that
    come from an aggregate or join by the keys, in as many partitions, are dealt by bucket already and make a file each."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    _written[path] = spark
    table_ = path.rsplit("/", 1)[1].replace("-", "_")
    df.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).option("compression", "zstd").saveAsTable(table_)
    out = spark.table(table_)
    out._stored_at, out._table = path, table_
    return out


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


@contextmanager
def by_bucket(spark: SparkSession, buckets: int) -> Iterator[int]:
    """While bucketed tables are written and joined: aggregates deal their rows by the buckets, and scans of sorted buckets of
    one file each tell the planner their order, so merge joins don't sort them again. Gives the number of buckets, which is
    the session's own where that can't be set."""
    with settings(spark, **{"spark.sql.shuffle.partitions": str(buckets), **IN_ORDER}):
        yield int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Scans of sorted buckets of one file each tell the planner their order.
IN_ORDER = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true"}


def drop_stored(df: DataFrame) -> None:
    """Deletes a table that `stored` or `stored_in_buckets` gave and that no later plan reads."""
    path = df._stored_at
    if hasattr(df, "_table"):
        df.sparkSession.sql(f"DROP TABLE {df._table}")
    delete(_written.pop(path), path)


@atexit.register
def release() -> None:
    """Deletes every table that `stored` wrote in this process and that is still there: to be called when the results are
    saved, as frames that operators returned still read them. It is done at the end of the process too."""
    while _written:
        path, spark = _written.popitem()
        if spark.sparkContext._jsc is not None:
            delete(spark, path)


def ascii_lower(col):
    return F.translate(col, UPPER, UPPER.lower())
