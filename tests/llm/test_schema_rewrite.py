import datetime as dt
import hashlib
import math
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from archivolt.llm import common
from archivolt.llm.schema_rewrite import (
    CLIENTS, Digests, Field, batches_of, client_files, drifted, fields_of, op12_drifted_schema_rewrite, placed, rewrite, rewrite_file, schema_of,
)

EPOCH = dt.datetime(1970, 1, 1)
EVOLVED = ["int64", "int64", "string", "timestamp[us]", "string", "string", "string", "int64", "string", "double"]


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}/work"


def place(path):
    return Path(path.removeprefix("file://"))


def text_of(value):
    if value is None:
        return "?"
    if isinstance(value, dt.datetime):
        return str((value - EPOCH) // dt.timedelta(microseconds=1))
    return str(math.floor(1048576 * value)) if isinstance(value, float) else str(value)


def brute(rows):
    """file_no -> what the query says of it, from the clients' rows."""
    crc = lambda text: zlib.crc32(str(text).encode())
    rows = sorted(rows, key=lambda r: (crc(r[0]), r[0]))
    size, out = 1 + len(rows) // 1000, {}
    for at in range(0, len(rows), size):
        number, part = at // size, [list(r) for r in rows[at : at + size]]
        version = crc(f"7:{number}") % 24
        version = 0 if version > 15 else version
        names = list(CLIENTS)
        if version & 1:
            names[4], names[5] = names[5], names[4]
        order = list(range(10))
        if version & 2:
            order = [0, *range(9, 0, -1)]
        if version & 4:
            order = [k for k in order if k not in (6, 7)]
        for r in part:
            if version & 4:
                r[6], r[7] = "none", -1
            if version & 8 and r[9] is not None:
                r[9] = float(np.float32(r[9]))
        sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
        out[number] = (
            version, len(part), sum(v is None for r in part for v in r), sha(",".join(str(r[0]) for r in part)),
            sha("\n".join("|".join(map(text_of, r)) for r in part)), ",".join(names[k] for k in order), ",".join(CLIENTS), version > 0,
        )
    return out


def test_query_against_brute_force(spark, sf_dir):
    want = brute([tuple(r) for r in spark.read.parquet(f"{sf_dir}/clients.parquet").select(*CLIENTS).collect()])
    got = op12_drifted_schema_rewrite(spark, sf_dir).collect()
    assert {r.file_no: (r.version, r.n_rows, r.n_nulls, r.ids_sha256, r.rows_sha256, r.start_columns, r.columns, r.rewritten) for r in got} == want
    assert len({r[0] for r in want.values()}) > 8
    homes = {place(r.path).parent for r in got}
    assert len(homes) == 1 and sorted(x.name for x in homes.pop().iterdir()) == sorted(place(r.path).name for r in got)
    for r in got:
        file = pq.ParquetFile(place(r.path))
        found = file.schema_arrow
        assert found.names == list(CLIENTS) and [str(t) for t in found.types] == EVOLVED and all(f.nullable for f in found)
        assert [int(f.metadata[b"PARQUET:field_id"]) for f in found] == list(range(1, 11))
        lines = "\n".join("|".join(map(text_of, x.values())) for x in file.read().to_pylist())
        assert hashlib.sha256(lines.encode()).hexdigest() == r.rows_sha256


def test_starting_files_drift_and_version_0_stays(spark, sf_dir, folder):
    clients = spark.read.parquet(f"{sf_dir}/clients.parquet").select(*CLIENTS)
    files, fields = client_files(clients, folder)
    rows, before = {r.client_id: r for r in clients.collect()}, {}
    for r in files.collect():
        file = pq.ParquetFile(place(r.path))
        want = schema_of(drifted(fields, r.version))
        assert file.schema_arrow.remove_metadata().equals(want.remove_metadata(), check_metadata=True)
        at = {int(f.metadata[b"PARQUET:field_id"]): k for k, f in enumerate(file.schema_arrow)}
        assert (len(at), 5 in at) == (8 if r.version & 4 else 10, True)
        for x in file.read().to_pylist():
            values = list(x.values())
            assert values[at[5]] == rows[values[at[1]]].name and values[at[6]] == rows[values[at[1]]].email
        before[r.path] = (r.version, place(r.path).stat().st_ino, place(r.path).read_bytes())
    done = rewrite(files, folder, fields).collect()
    for r in done:
        version, node, body = before[r.path]
        assert r.rewritten == (version > 0) == (place(r.path).stat().st_ino != node) == (place(r.path).read_bytes() != body)
    assert [x.name for x in place(folder).iterdir()] == ["files"]
    again = {r.path: r for r in rewrite(files, folder, fields).collect()}  # all have the evolved schema now
    assert not any(r.rewritten for r in again.values()) and all(again[r.path].rows_sha256 == r.rows_sha256 for r in done)


def test_places_with_hot_keys_ties_and_nulls(spark):
    rows = [(7, "a")] * 400 + [(7, f"t{i % 50}") for i in range(300)] + [(None, "n"), (None, None)] + [(i, "x") for i in range(300)]
    df = spark.createDataFrame(rows, "k int, v string").repartition(5)
    with common.settings(spark, **{"spark.sql.shuffle.partitions": "16"}):
        got, total = placed(df, F.col("k"))
        found = sorted(got.collect(), key=lambda r: r.place)
    assert total == len(rows) and [r.place for r in found] == list(range(total))
    assert [r.k for r in found] == sorted((r[0] for r in rows), key=lambda k: (k is not None, k or 0))
    assert sorted(map(str, ((r.k, r.v) for r in found))) == sorted(map(str, rows))
    assert placed(df.limit(0), F.col("k"))[1] == 0


def test_odd_rows_and_empty_tables(spark, folder):
    clients = "client_id bigint, master_id bigint, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double"
    odd = [
        (None, None, None, None, None, None, None, None, None, None), (1, 1, "", EPOCH, "a|b", "c\nd", "é" * 100_000, 3, "s", float("nan")),
        (1, 1, "", EPOCH, "a|b", "c\nd", "?", 3, "s", float("inf")), (2, -5, "x", dt.datetime(1900, 1, 1), "n", "e", None, 4, "s", -0.1),
        (2, -5, "x", dt.datetime(1900, 1, 1), "n", "e", None, 4, "s", -0.1), (3, 1, "x", EPOCH, "n", "e", "c", 4, "s", 1e300),
    ]
    df = spark.createDataFrame(odd, clients)
    files, fields = client_files(df, folder, parts=3)
    done = rewrite(files.union(files), folder, fields)
    assert sum(r.n_rows for r in done.collect()) == 6 and done.count() == 2
    kept = [x for r in done.orderBy("path").collect() for b in batches_of(r.path) for x in b.to_pylist()]
    assert [r["client_id"] for r in kept] == sorted((r[0] for r in odd), key=lambda i: (i is not None, zlib.crc32(str(i).encode()), i))
    files, fields = client_files(df.limit(0), folder + "-none")
    assert files.count() == rewrite(files, folder + "-none", fields).count() == 0


def test_one_file_in_batches(tmp_path, folder):
    fields = [Field(1, "a", pa.int64()), Field(2, "b", pa.string(), "none"), Field(3, "c", pa.float64())]
    rows = pa.table({"c2": pa.array([1.5, None, -0.25] * 50, pa.float32()), "old": pa.array(range(150), pa.int32()), "gone": ["x"] * 150})
    ids = [3, 1, 9]
    rows = rows.cast(pa.schema([f.with_metadata({"PARQUET:field_id": str(k)}) for f, k in zip(rows.schema, ids)]))
    path = f"file://{tmp_path}/one.parquet"
    pq.write_table(rows, place(path), row_group_size=40)
    got = [rewrite_file(path, folder, fields, n) for n in (1, 7, 1000)]
    assert got[0] == got[1] == got[2] and got[0]["n_nulls"] == 50 and got[0]["rewritten"]
    want = "\n".join(f"{i}|none|{'?' if c is None else math.floor(c * 1048576)}" for i, c in enumerate([1.5, None, -0.25] * 50))
    assert got[0]["rows_sha256"] == hashlib.sha256(want.encode()).hexdigest()
    out = pq.read_table(place(f"{folder}/rewritten/one.parquet"))
    assert out.column("a").to_pylist() == list(range(150)) and set(out.column("b").to_pylist()) == {"none"}
    pq.write_table(pa.table({"b": ["q"], "z": [1]}), place(path))  # no ids: by name
    rewrite_file(path, folder, fields)
    assert pq.read_table(place(f"{folder}/rewritten/one.parquet")).to_pylist() == [{"a": None, "b": "q", "c": None}]
    pq.write_table(rows.slice(0, 0), place(path))
    assert rewrite_file(path, folder, fields)["n_rows"] == 0 and Digests().ids.hexdigest() == hashlib.sha256(b"").hexdigest()


def test_fields(spark):
    df = spark.createDataFrame([], "a int, b string")
    assert fields_of(df, {"a": pa.int64()}, {"b": "x"}) == [Field(1, "a", pa.int64()), Field(2, "b", pa.string(), "x")]
