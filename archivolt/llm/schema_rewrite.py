"""Drifted schemas: Parquet files whose columns were renamed, moved, dropped or narrowed become files of one evolved schema.

Columns are matched by Parquet field id. Each task streams row-group batches through an id-indexed column plan, so memory
is bounded by one batch, and sha256 digests grow with the rows that pass.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow.fs import FileSystem, FileType
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from archivolt.llm.common import drop_stored, stored, table
from archivolt.sources.shared import delete, new_folder

#: Rows that a task holds at once, and of a row group that it writes.
BATCH = 1 << 16


@dataclass(frozen=True)
class Field:
    """A column: its lasting id, its present name and type, and what stands in files that lack it."""

    id: int
    name: str
    type: pa.DataType
    fill: object = None

    def arrow(self) -> pa.Field:
        return pa.field(self.name, self.type, True, {b"PARQUET:field_id": str(self.id).encode()})


def fields_of(df: DataFrame, types: dict[str, pa.DataType] | None = None, fills: dict[str, object] | None = None) -> list[Field]:
    """The columns of `df`, numbered from 1, with other types and fills where given."""
    own = {f.name: to_arrow_type(f.dataType) for f in df.schema} | (types or {})
    return [Field(k, name, own[name], (fills or {}).get(name)) for k, name in enumerate(df.columns, 1)]


def schema_of(fields: list[Field]) -> pa.Schema:
    return pa.schema([f.arrow() for f in fields])


def plan(found: pa.Schema, fields: list[Field]) -> list[int | None]:
    """For each evolved field the place of the found column with its id, or None. A file that has no ids at all is matched by name."""
    ids = {int((f.metadata or {}).get(b"PARQUET:field_id", -1)): k for k, f in enumerate(found)}
    if set(ids) <= {-1}:
        names = {f.name: k for k, f in enumerate(found)}
        return [names.get(f.name) for f in fields]
    return [ids.get(f.id) for f in fields]


def evolved(batch: pa.RecordBatch, places: list[int | None], fields: list[Field]) -> pa.RecordBatch:
    """The batch cast and filled through its column plan."""
    columns = [
        pa.repeat(pa.scalar(f.fill, f.type), len(batch)) if k is None else batch.column(k).cast(f.type) for k, f in zip(places, fields)
    ]
    return pa.RecordBatch.from_arrays(columns, schema=schema_of(fields))


def rendered(column: pa.Array) -> pa.Array:
    """Values as text: timestamps as microseconds since 1970, floating numbers as floor(1048576 * x), null as `?`."""
    if pa.types.is_timestamp(column.type):
        column = column.cast(pa.timestamp("us", column.type.tz)).cast(pa.int64())
    elif pa.types.is_floating(column.type):
        scaled = pc.floor(pc.multiply(column.cast(pa.float64()), 1048576.0))
        try:
            column = scaled.cast(pa.int64())
        except pa.ArrowInvalid:  # beyond 64 bits, or not a number
            whole = [None if x is None else str(int(x)) if math.isfinite(x) else str(x) for x in scaled.to_pylist()]
            column = pa.array(whole, pa.string())
    return pc.fill_null(column.cast(pa.string()), "?")


class Digests:
    """Counts and incremental sha256 digests of the rows that pass: of the first column, and of all columns."""

    def __init__(self):
        self.rows = self.nulls = 0
        self.ids, self.lines = hashlib.sha256(), hashlib.sha256()

    def add(self, batch: pa.RecordBatch) -> None:
        if not len(batch):
            return
        texts = [rendered(c) for c in batch.columns]
        for digest, values, mark in ((self.ids, texts[0], ","), (self.lines, pc.binary_join_element_wise(*texts, "|"), "\n")):
            digest.update(((mark if self.rows else "") + mark.join(values.to_pylist())).encode())
        self.rows += len(batch)
        self.nulls += sum(c.null_count for c in batch.columns)


def _at(uri: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(uri)


@contextmanager
def _whole_file(folder: str, target: str) -> Iterator:
    """A stream to a file of an attempt's own, which takes the target's place only when it is whole: a task that is lost or
    runs twice leaves the target as it was or as it should be."""
    system, own = _at(f"{folder}/attempts/{uuid.uuid4().hex}")
    system.create_dir(own.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(own) as stream:
        yield stream
    where = _at(target)[1]
    system.create_dir(where.rsplit("/", 1)[0], recursive=True)
    system.move(own, where)


def batches_of(uri: str, rows: int = BATCH) -> Iterator[pa.RecordBatch]:
    """A file's batches, row group by row group; one without rows if it has none."""
    system, where = _at(uri)
    with system.open_input_file(where) as stream, pq.ParquetFile(stream, pre_buffer=False) as file:
        yield pa.RecordBatch.from_pylist([], schema=file.schema_arrow)
        for group in range(file.num_row_groups):
            yield from file.iter_batches(batch_size=rows, row_groups=[group])


def rewrite_file(uri: str, folder: str, fields: list[Field], rows: int = BATCH) -> dict:
    """Writes the evolved form of one file to `folder`/rewritten, unless the file has that form already."""
    batches, seen = batches_of(uri, rows), Digests()
    found = next(batches).schema
    schema, places = schema_of(fields), plan(found, fields)
    same = found.remove_metadata().equals(schema.remove_metadata(), check_metadata=True)
    if same:
        for batch in batches:
            seen.add(batch)
    else:
        with _whole_file(folder, f"{folder}/rewritten/{uri.rsplit('/', 1)[1]}") as stream, pq.ParquetWriter(stream, schema, compression="zstd") as writer:
            for batch in batches:
                out = evolved(batch, places, fields)
                writer.write_batch(out)
                seen.add(out)
    names = lambda s: ",".join(s.names)
    return {
        "path": uri, "n_rows": seen.rows, "n_nulls": seen.nulls, "ids_sha256": seen.ids.hexdigest(), "rows_sha256": seen.lines.hexdigest(),
        "start_columns": names(found), "columns": names(schema), "rewritten": not same,
    }


_DONE = "path string, n_rows long, n_nulls long, ids_sha256 string, rows_sha256 string, start_columns string, columns string, rewritten boolean"


def _each_path(work: Callable[[str], dict], kinds: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                yield pa.RecordBatch.from_pylist([work(path)], schema=kinds)

    return run


def rewrite(files: DataFrame, folder: str, fields: list[Field], rows: int = BATCH) -> DataFrame:
    """The Parquet files at `files.path` (column `path`: addresses that pyarrow knows) turned into the evolved schema, each in
    its own place; one row per file: path, n_rows, n_nulls, ids_sha256, rows_sha256, start_columns, columns, rewritten.

    Columns are matched by field id (by name in files without ids), cast, and filled where a file lacks them; columns that the
    evolved schema lacks go. Rows and their order stay; nulls stay null. A file of the evolved schema is only read. A file
    without rows gets the evolved schema too; without files the result is empty; a path given twice is done once.

    Rewriting and taking the old files' places are two jobs, with a written table between them: whatever is lost in the
    first, the old files are still there, and the second moves what isn't moved yet. Nothing but a file's path and its
    row of the result leaves a task. `folder` holds work in progress, beside the files, on the same file system.
    """
    spark = files.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # dealt by number before the paths are made distinct: an exchange of distinct() itself could be merged into one task
    paths = files.select("path").where(F.col("path").isNotNull()).repartition(n, "path").distinct()
    kinds = pa.schema([(f.split()[0], {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[f.split()[1]]) for f in _DONE.split(", ")])
    done = stored(paths.mapInArrow(_each_path(lambda path: rewrite_file(path, folder, fields, rows), kinds), _DONE), "rewritten")

    def take_place(path: str) -> dict:
        system, new = _at(f"{folder}/rewritten/{path.rsplit('/', 1)[1]}")
        if system.get_file_info(new).type == FileType.File:
            system.move(new, _at(path)[1])
        return {"path": path}

    moved = done.where("rewritten").select("path").repartition(n, "path")
    moved.mapInArrow(_each_path(take_place, pa.schema([("path", pa.string())])), "path string").write.format("noop").mode("overwrite").save()
    for name in ("attempts", "rewritten"):
        delete(spark, f"{folder}/{name}")
    return done


def placed(df: DataFrame, *keys: Column) -> tuple[DataFrame, int]:
    """`df` with its rows' places (column `place`, from 0) in the order of `keys`, and the number of rows. Rows that tie are
    ordered by a hash of the row, and equal rows are dealt at random, so that one key with a third of all rows is
    ordered by many tasks. The rows are ordered once, written, and counted by range; only the ranges' counts (one for each
    shuffle partition) reach the driver."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [*keys, F.xxhash64(*df.columns), F.pmod(F.monotonically_increasing_id(), F.lit(1024))]
    keyed = df.withColumns({f"__k{i}": k for i, k in enumerate(order)})
    names = [f"__k{i}" for i in range(len(order))]
    dealt = keyed.repartitionByRange(n, *names).sortWithinPartitions(*names).drop(*names)
    kept = stored(dealt.withColumn("__at", F.monotonically_increasing_id()), "placed")
    counts = dict(kept.groupBy(F.shiftright("__at", 33).alias("__range")).count().collect())
    before, total = [], 0
    for k in sorted(counts):
        before.append((k, total))
        total += counts[k]
    ranges = spark.createDataFrame(before, "__range long, __before long")
    out = kept.withColumn("__range", F.shiftright("__at", 33)).join(ranges, "__range")
    out = out.withColumn("place", F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__range", "__before", "__at")
    out._stored_at = kept._stored_at
    return out, total


def drifted(fields: list[Field], version: int) -> list[Field]:
    """The fields of a starting file, by bits. 1: name and email swap names. 2: the columns after the first reverse.
    4: nation_id and city are missing. 8: balance is float, nation_id int."""
    out = list(fields)
    if version & 1:
        other = {"name": "email", "email": "name"}
        out = [replace(f, name=other.get(f.name, f.name)) for f in out]
    if version & 2:
        out = [out[0], *out[:0:-1]]
    if version & 4:
        gone = {f.id for f in fields if f.name in ("nation_id", "city")}
        out = [f for f in out if f.id not in gone]
    if version & 8:
        narrow = {f.id: {"balance": pa.float32(), "nation_id": pa.int32()}.get(f.name) for f in fields}
        out = [replace(f, type=narrow[f.id] or f.type) for f in out]
    return out


def write_files(rows: DataFrame, folder: str, fields: list[Field], shape: Callable[[list[Field], int], list[Field]] = drifted) -> DataFrame:
    """Writes one Parquet file per file_no, in the order of `place`, shaped by `version`; gives (file_no, version, path).
    rows: the evolved fields' columns, file_no, version (one for each file_no) and place. A task streams the files of its
    partition one after the other and holds one batch."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("file_no", "version", "place", *(f.name for f in fields)).repartition(n, "file_no").sortWithinPartitions("file_no", "place")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
        for batch in batches:
            number = batch.column("file_no").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
            for a, b in zip(edges, edges[1:]):
                if b > a:
                    yield int(number[a]), batch.column("version")[a].as_py(), batch.slice(a, b - a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = runs(batches)
        part = next(parts, None)
        while part:
            number, version, _ = part
            own = shape(fields, version)
            at = [3 + next(k for k, f in enumerate(fields) if f.id == g.id) for g in own]
            path = f"{folder}/files/part-{number:05d}.parquet"
            with _whole_file(folder, path) as stream, pq.ParquetWriter(stream, schema_of(own), compression="zstd") as writer:
                while part and part[0] == number:
                    columns = [part[2].column(k).cast(f.type, safe=False) for k, f in zip(at, own)]
                    writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=schema_of(own)))
                    part = next(parts, None)
            yield pa.RecordBatch.from_pylist([{"file_no": number, "version": version, "path": path}])

    return stored(dealt.mapInArrow(run, "file_no long, version long, path string"), "written")


def client_files(clients: DataFrame, folder: str, parts: int = 1000) -> tuple[DataFrame, list[Field]]:
    """Lays the clients out as drifted starting files in `folder`/files, and gives these (file_no, version, path) and the
    evolved fields. Rows are ordered by the CRC-32 of the decimal client_id, then client_id, nulls first; each file takes
    1 + floor(rows / `parts`) of them. Extra columns are left out; an empty table gives no files."""
    fields = fields_of(clients, {"nation_id": pa.int64()}, {"nation_id": -1, "city": "none"})
    crc = lambda text: F.crc32(text.cast("string").cast("binary"))
    ordered, total = placed(clients, crc(F.col("client_id")), F.col("client_id"))
    rows = ordered.withColumn("file_no", F.floor(F.col("place") / F.lit(1 + total // parts)).cast("long"))
    version = crc(F.concat(F.lit("7:"), F.col("file_no").cast("string"))) % 24
    files = write_files(rows.withColumn("version", F.when(version > 15, 0).otherwise(version)), folder, fields)
    drop_stored(ordered)
    return files, fields


CLIENTS = ("client_id", "master_id", "source", "updated_at", "name", "email", "city", "nation_id", "segment", "balance")


def op12_drifted_schema_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "clients")
    files, fields = client_files(table(spark, sf_dir, "clients", *CLIENTS), folder)
    done = rewrite(files, folder, fields)
    return files.join(done, "path").select(
        "file_no", "version", "n_rows", "n_nulls", "ids_sha256", "rows_sha256", "start_columns", "columns", "path", "rewritten"
    )
