"""Structured Streaming forms of the incremental steps."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from archivolt.sources.shared import delete


def table_stream(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    """A Parquet table, or the files of a folder as they come, with the schema of what is there."""
    folder, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", per_trigger)
    return reader.option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") and not _is_folder(spark, path) else reader.parquet(path)


def _is_folder(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()


def daily_counts(events: DataFrame, time: str, by: list[str], lateness: str = "62 days") -> DataFrame:
    """Counts by tumbling day; in append mode a day is emitted once it is closed, so open days never show."""
    seen = events.withWatermark(time, lateness)
    return seen.groupBy(F.window(time, "1 day"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.to_date("window.start").alias("day"), *by, "n")


def monthly_counts(events: DataFrame, time: str, by: list[str], lateness: str = "62 days") -> DataFrame:
    """Counts by calendar month. Months have no fixed length, so they are keys, and updates carry late records."""
    month = F.date_trunc("month", time).alias("month")
    return events.withWatermark(time, lateness).groupBy(month, *by).agg(F.count(F.lit(1)).alias("n"))


def sliding_counts(events: DataFrame, time: str, length: str = "7 days", step: str = "1 day", lateness: str = "1 day") -> DataFrame:
    seen = events.withWatermark(time, lateness)
    return seen.groupBy(F.window(time, length, step)).agg(F.count(F.lit(1)).alias("n")).select("window.start", "window.end", "n")


def sessions(events: DataFrame, time: str, key: str, gap: str = "10 days", lateness: str = "62 days") -> DataFrame:
    """Chains of a key's events within `gap`, a gap as long included."""
    seen = events.withWatermark(time, lateness)
    out = seen.groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("n"), F.max(time).alias("last"))
    return out.select(key, F.col("session_window.start").alias("first"), "last", "n")


def without_repeats(events: DataFrame, keys: list[str], time: str, lateness: str = "62 days") -> DataFrame:
    """Each key once while it can still come again; the state is dropped behind the watermark."""
    return events.withWatermark(time, lateness).dropDuplicatesWithinWatermark(keys)


def replace_slices(stream: DataFrame, path: str, key: str, checkpoint: str):
    """Each batch replaces the slices of the table that it holds, so that running a batch again changes nothing."""

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def disorder(rows: DataFrame, time: str) -> str:
    """How late a row of this table can come where its files are read in any order: the whole span of its times, a minute
    at least. With it as the lateness no row is dropped."""
    a, b = rows.agg(F.min(time), F.max(time)).first()
    return f"{max(60, math.ceil((b - a).total_seconds())) if a is not None else 60} seconds"


def drain(stream: DataFrame, name: str, mode: str, checkpoint: str, keys: list[str] = ()) -> DataFrame:
    """Runs a stream over all that is there and gives what it put out, from Parquet in the checkpoint's folder. Each batch
    has a folder of its own, which running it again replaces. Of "append" all rows count; of "update" the last one of each
    of the `keys`; of "complete" the last batch, the only one that is kept."""
    spark = stream.sparkSession
    path, last = f"{checkpoint}/{name}-out", []

    def put(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={k}")
        if mode == "complete":
            for old in {*last} - {k}:
                delete(spark, f"{path}/batch={old}")
                last.remove(old)
        last.append(k)

    query = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{checkpoint}/{name}")
    query.trigger(availableNow=True).start().awaitTermination()
    if not last:
        return spark.createDataFrame([], stream.schema)
    out = spark.read.schema(StructType([*stream.schema, StructField("batch", LongType())])).parquet(path)
    if mode == "update":
        newest = F.max_by(F.struct(*stream.columns), "batch").alias("row")
        return out.groupBy(*(F.col(k).alias(f"__{k}") for k in keys)).agg(newest).select("row.*")
    return out.drop("batch")
