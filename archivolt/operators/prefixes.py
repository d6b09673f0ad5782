"""Texts that begin with each other, by sorted neighbours: a stack of open beginnings instead of pairs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivolt.sources.shared import settings, written

#: First bytes of a text by which texts are dealt to partitions; those that agree on them are streamed by one task.
BOUNDARY = 256
#: Beginnings that each partition sends the driver, which draws the boundaries from them; Spark's own number is four times that.
SAMPLED = "25"


def digest_of(text: str | Column) -> Column:
    return F.unhex(F.sha2(text, 256))


@dataclass
class _Open:
    """A text that the next rows may continue. least: by group of its own values and those of the texts that it continues; inner:
    of the values of the texts that continue it. One that an earlier run handed over has a digest instead of its text."""

    size: int
    text: bytes | None
    digest: bytes | None
    least: dict
    asked: list
    inner: dict = field(default_factory=dict)

    def begins(self, text: bytes) -> bool:
        if len(text) < self.size:
            return False
        return text.startswith(self.text) if self.text is not None else sha256(text[: self.size]).digest() == self.digest

    def named(self) -> bytes:
        if self.digest is None:
            self.digest = sha256(self.text).digest()
        return self.digest

    def answers(self, values: dict) -> Iterator[tuple]:
        for group in self.asked:
            if group in values:
                yield self.named(), group, values[group]


def _merge(into: dict, more: dict) -> dict:
    for group, value in more.items():
        if group not in into or value < into[group]:
            into[group] = value
    return into


def _close(stack: list[_Open]) -> Iterator[tuple]:
    done = stack.pop()
    if stack:
        _merge(stack[-1].inner, done.inner)
    yield from done.answers(done.inner)


def _walk(rows: Iterator[tuple], stack: list[_Open]) -> Iterator[tuple]:
    """Goes over sorted rows (text, known, asked) and gives (digest, group, value) for what is asked: of what a text continues
    and is when it comes, of what continues it when it closes. What is open at the end stays on the stack."""
    for text, known, asked in rows:
        while stack and not stack[-1].begins(text):
            yield from _close(stack)
        values = dict(known)
        if stack:
            _merge(stack[-1].inner, values)
            values = _merge(values, stack[-1].least)
        own = _Open(len(text), text, None, values, asked)
        yield from own.answers(values)
        stack.append(own)


def _pairs(known: list) -> list[tuple]:
    return [(k["group"], k["value"]) for k in known]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """(place, rows) of the sorted runs that a task reads, one after the other."""
    rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("part", "block", "body", "known", "asked"))))
    row = next(rows, None)

    def own(place: tuple) -> Iterator[tuple]:
        nonlocal row
        while row is not None and row[:2] == place:
            yield row[2], _pairs(row[3]), row[4]
            row = next(rows, None)

    while row is not None:
        yield row[:2], own(row[:2])


_FOUND = pa.schema([("digest", pa.binary()), ("group", pa.int64()), ("value", pa.int64())])
_KNOWN = pa.list_(pa.struct([("group", pa.int64()), ("value", pa.int64())]))
_END = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("size", pa.int64()), ("digest", pa.binary()), ("known", _KNOWN), ("asked", pa.list_(pa.int64()))])


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 10_000) -> Iterator[pa.RecordBatch]:
    kept: list[tuple] = []
    for row in chain(rows, [None]):
        if kept and (row is None or len(kept) == size):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept), schema)], schema=schema)
            kept.clear()
        kept.append(row)


def prefix_relatives(texts: DataFrame, boundary: int = BOUNDARY) -> DataFrame:
    """For each distinct text and each group that it asks for the least value of that group among the texts that begin with it or
    that it begins with, itself included: (digest, group, value); `digest_of` the text; what has no such value has no row.

    texts: (text STRING, known ARRAY<STRUCT<group: BIGINT, value: BIGINT>>, asked ARRAY<BIGINT>), a row for each distinct text;
    null texts are left out. A text is moved twice whatever its groups: dealt to range partitions and written in order.
    There the continuations of a text follow it at once, so a row meets all that it continues on one stack, whose top
    alone it is compared with: texts that share a beginning cost rows, never pairs.

    The written runs are read twice, without exchange. First for what is open at each run's end, which is handed to
    the runs after it as lengths, digests and values; only these reach the driver, for each run the texts that its last one
    continues. Texts are ordered by their UTF-8 bytes; a boundary between partitions falls between texts that differ in their
    first `boundary` bytes.
    """
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = texts.where("text IS NOT NULL").select(
        F.encode("text", "UTF-8").alias("body"), F.col("known").cast("array<struct<group:bigint,value:bigint>>"), F.col("asked").cast("array<bigint>")
    )
    ranged = rows.repartitionByRange(n, F.substring("body", 1, boundary)).withColumn("part", F.spark_partition_id().cast("long"))
    with settings(texts.sparkSession, **{"spark.sql.execution.rangeExchange.sampleSizePerPartition": SAMPLED}):
        table = written(ranged.sortWithinPartitions("body"), "sorted-texts")
    runs = table.select("part", F.input_file_block_start().alias("block"), "body", "known", "asked")

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for place, own in _runs(batches):
            stack: list[_Open] = []
            for _ in _walk(own, stack):
                pass
            open_ = ((*place, x.size, x.named(), [{"group": g, "value": v} for g, v in x.least.items()], x.asked) for x in stack)
            yield from _batches(open_, _END)

    kind = "part bigint, block bigint, size bigint, digest binary, known array<struct<group:bigint,value:bigint>>, asked array<bigint>"
    handed = sorted(runs.mapInArrow(ends, kind).collect(), key=lambda r: (r.part, r.block, r["size"]))
    handed = [((r.part, r.block), r["size"], bytes(r.digest), dict(_pairs(r.known)), list(r.asked)) for r in handed]

    def relate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def relatives(place: tuple, own: Iterator[tuple]) -> Iterator[tuple]:
            first, stack = next(own), []
            for before, size, digest, least, asked in handed:  # shorter ones come first, as they come before what continues them
                x = _Open(size, None, digest, dict(least), asked)
                if before < place and x.begins(first[0]):
                    _merge(x.least, stack[-1].least if stack else {})
                    stack.append(x)
            yield from _walk(chain([first], own), stack)
            while stack:
                yield from _close(stack)

        for place, own in _runs(batches):
            yield from _batches(relatives(place, own), _FOUND)

    found = runs.mapInArrow(relate, "digest binary, `group` bigint, value bigint")
    return found.groupBy("digest", "group").agg(F.min("value").alias("value"))
