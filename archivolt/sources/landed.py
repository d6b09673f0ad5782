"""A folder of landed months as a data source for batch and stream reads, with a guard against truncated months."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_type
from pyspark.sql.types import StringType, StructType

#: What stands beside the files of a month that has landed: its number of rows, what its source reported, and the landing.
MARK = "_month.json"
REPORT = "month string, n_docs long, hits long, landing long, complete boolean"


@dataclass
class Month:
    month: str
    n_docs: int
    hits: int
    landing: int

    @property
    def complete(self) -> bool:
        return self.n_docs >= self.hits


def landed(path: str) -> list[Month]:
    """The months in a folder, in order. A month without its mark is still being written, and isn't there yet."""
    system, where = FileSystem.from_uri(path)
    out = []
    for info in system.get_file_info(FileSelector(where, allow_not_found=True)):
        if info.type == FileType.Directory and info.base_name.startswith("month="):
            mark = f"{info.path}/{MARK}"
            if system.get_file_info(mark).type == FileType.File:
                with system.open_input_stream(mark) as stream:
                    out.append(Month(info.base_name.removeprefix("month="), **json.loads(stream.read())))
    return sorted(out, key=lambda m: m.month)


def land(rows: DataFrame, hits: DataFrame, path: str) -> None:
    """Puts rows (with a `month`, yyyy-MM) into the folder; each of their months takes the place of what it held before.

    `hits`: (month, hits), what the source reported; a month that it lacks counts as whole, and one that has only hits as landed
    without rows. The mark is written last, so an interrupted landing leaves a month that isn't there. Only the counts by month
    reach the driver. Rows without a month are left out.
    """
    spark = rows.sparkSession
    landing = max([time.time_ns() // 1000, *(m.landing + 1 for m in landed(path))])
    rows = rows.where(F.col("month").isNotNull())
    rows.hint("rebalance", F.col("month")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)
    own = StructType([f for f in rows.schema if f.name != "month"]).add("month", StringType())
    ours = hits.where(F.col("month").isNotNull()).groupBy("month").agg(F.max("hits").alias("hits"))
    here = spark.read.schema(own).parquet(path).groupBy("month").agg(F.count(F.lit(1)).alias("n_docs"))
    untouched = {m.month for m in landed(path)}
    counts = here.join(ours, "month", "full").select("month", F.coalesce("n_docs", F.lit(0)).alias("n"), F.coalesce("hits", F.lit(0)).alias("hits"))
    system, where = FileSystem.from_uri(path)
    for month, n, reported in sorted(map(tuple, counts.collect())):
        if month not in untouched:
            folder = f"{where}/month={month}"
            system.create_dir(folder)
            with system.open_output_stream(f"{folder}/{MARK}.tmp") as stream:
                stream.write(json.dumps({"n_docs": n, "hits": reported, "landing": landing}).encode())
            system.move(f"{folder}/{MARK}.tmp", f"{folder}/{MARK}")


@dataclass
class LandedFile(InputPartition):
    month: str
    path: str


class _Files:
    """What batch and stream reads share: the files of some months, and the rows of a file."""

    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema

    def files(self, months: list[Month]) -> list[LandedFile]:
        system, where = FileSystem.from_uri(self.path)
        out = []
        for m in months:
            infos = system.get_file_info(FileSelector(f"{where}/month={m.month}", allow_not_found=True))
            out += [LandedFile(m.month, i.path) for i in infos if i.type == FileType.File and i.base_name[0] not in "._"]
        return sorted(out, key=lambda f: f.path)

    def read(self, partition: LandedFile | None) -> Iterator[pa.RecordBatch]:
        """A file's rows, a batch at a time; only the columns of the schema are read, and those that the file lacks are null.
        Spark gives None where there are no files."""
        if partition is None:
            return
        system, _ = FileSystem.from_uri(self.path)
        with system.open_input_file(partition.path) as stream, pq.ParquetFile(stream, pre_buffer=False) as file:
            names = set(file.schema_arrow.names)
            for batch in file.iter_batches(10_000, columns=[f.name for f in self.schema if f.name in names]):
                columns = []
                for f in self.schema:
                    kind = to_arrow_type(f.dataType)
                    if f.name == "month":
                        columns.append(pa.repeat(pa.scalar(partition.month, kind), batch.num_rows))
                    elif f.name in names:
                        columns.append(batch.column(f.name).cast(kind))
                    else:
                        columns.append(pa.nulls(batch.num_rows, kind))
                yield pa.RecordBatch.from_arrays(columns, self.schema.names)


class LandedReader(_Files, DataSourceReader):
    def __init__(self, path: str, schema: StructType, since: str, until: str):
        super().__init__(path, schema)
        self.since, self.until = since, until

    def partitions(self) -> list[LandedFile]:
        return self.files([m for m in landed(self.path) if m.complete and self.since <= m.month <= self.until])


class ReportReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for m in landed(self.path):
            yield m.month, m.n_docs, m.hits, m.landing, m.complete


class LandedStream(_Files, DataSourceStreamReader):
    """Offsets are landings: a batch has the whole months of the landings since the last one."""

    def initialOffset(self) -> dict:
        return {"landing": 0}

    def latestOffset(self) -> dict:
        return {"landing": max((m.landing for m in landed(self.path)), default=0)}

    def partitions(self, start: dict, end: dict) -> list[LandedFile]:
        return self.files([m for m in landed(self.path) if m.complete and start["landing"] < m.landing <= end["landing"]])

    def commit(self, end: dict) -> None:
        pass


class LandedMonths(DataSource):
    """`landed_months`: a folder of months that `land` filled. Options: `path`; `since` and `until` (yyyy-MM, both included), months
    outside of which aren't opened; `report` (true): a row for each month in place of its rows.

    A month that holds fewer rows than its source reported is truncated: it is read by nobody, and the report tells of it. When it
    lands again whole, batch reads have it and a stream gives it next; a whole month that lands again comes again in the stream.
    An empty folder, or one that isn't there, has no rows; its schema must be given."""

    @classmethod
    def name(cls) -> str:
        return "landed_months"

    def _report(self) -> bool:
        return self.options.get("report", "false").lower() == "true"

    def schema(self) -> StructType | str:
        if self._report():
            return REPORT
        path = self.options["path"]
        system, _ = FileSystem.from_uri(path)
        for file in _Files(path, StructType()).files(landed(path)):
            with system.open_input_file(file.path) as stream:
                return from_arrow_schema(pq.read_schema(stream), prefer_timestamp_ntz=True).add("month", StringType())
        raise ValueError(f"{path} holds no files to take a schema from")

    def reader(self, schema: StructType) -> DataSourceReader:
        if self._report():
            return ReportReader(self.options["path"])
        return LandedReader(self.options["path"], schema, self.options.get("since", ""), self.options.get("until", "9999-99"))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return LandedStream(self.options["path"], schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LandedMonths)
