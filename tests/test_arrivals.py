"""Landed months, chains, variants and parts: each against brute force."""

import json
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from archivolt.operators.closure import follow
from archivolt.plans.catalogue import QUERIES
from archivolt.sources import landed, parts, variants
from archivolt.streaming import timers


def brute_ends(links):
    to = {}
    for a, b in links:
        if a is not None:
            to.setdefault(a, []).append(b)
    to = {a: None if a in bs else min((b for b in bs if b is not None), default=None) for a, bs in to.items()}
    out = {}
    for a in to:
        seen, at = [a], a
        while to.get(at) is not None and to[at] not in seen:
            at = to[at]
            seen.append(at)
        if to.get(at) is None:
            out[a] = (at, len(seen) - 1, False)
        else:
            out[a] = (min(seen[seen.index(to[at]) :]), None, True)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_follow(spark, seed):
    r = random.Random(seed)
    links = [(k, k - 1 if k % 40 else None) for k in range(1, 121)]  # deep chains
    links += [(200 + k, 200 + (k + 1) % n) for n in (1, 2, 7) for k in range(n)] if seed else []
    links += [(k, r.choice([None, k, *range(300, 340), 205])) for k in range(300, 340)] + [(None, 3), (301, 302), (301, 302), (500, 501)]
    got = {x.node: (x.root, x.hops, x.cyclic) for x in follow(spark.createDataFrame(links, "a int, b int"), "a", "b").collect()}
    assert got == brute_ends(links)


def test_follow_cycle_and_empty(spark):
    links = [(k, (k + 1) % 37) for k in range(37)] + [(100 + k, 101 + k) for k in range(20)] + [(120, 5)]
    got = {x.node: (x.root, x.hops, x.cyclic) for x in follow(spark.createDataFrame(links, "a int, b int"), "a", "b").collect()}
    assert got == brute_ends(links) and got[100] == (0, None, True)
    assert follow(spark.createDataFrame([], "a int, b int"), "a", "b").collect() == []


def months(spark, path, **options):
    reader = spark.read.format("landed_months").option("path", path)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader


def test_landed_months(spark, tmp_path):
    landed.register(spark)
    path, schema = f"file://{tmp_path}/in", "id int, title string, month string"
    assert months(spark, path).schema(schema).load().count() == 0
    rows = spark.createDataFrame([(1, "a", "2024-01"), (2, None, "2024-01"), (3, "c", "2024-02"), (4, "d", None)], schema)
    landed.land(rows, spark.createDataFrame([("2024-01", 2), ("2024-02", 3), ("2024-03", 5)], "month string, hits long"), path)
    report = {r.month: (r.n_docs, r.hits, r.complete) for r in months(spark, path, report="true").load().collect()}
    assert report == {"2024-01": (2, 2, True), "2024-02": (1, 3, False), "2024-03": (0, 5, False)}
    assert sorted(r.id for r in months(spark, path).load().collect()) == [1, 2]

    def resume():
        stream = spark.readStream.format("landed_months").schema(schema).option("path", path).load()
        timers.resume(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
        return sorted(r.id for r in spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/out").collect())

    assert resume() == [1, 2]
    assert resume() == [1, 2]
    again = spark.createDataFrame([(k, "x", "2024-02") for k in (3, 5, 6)], schema)
    landed.land(again, spark.createDataFrame([("2024-02", 3)], "month string, hits long"), path)
    assert resume() == [1, 2, 3, 5, 6]
    assert [r.id for r in months(spark, path, since="2024-02", until="2024-02").load().orderBy("id").collect()] == [3, 5, 6]
    more = months(spark, path).schema("month string, extra double, id int").load().orderBy("id").first()
    assert (more.month, more.extra, more.id) == ("2024-01", None, 1)
    os.remove(f"{tmp_path}/in/month=2024-01/{landed.MARK}")  # a landing that was interrupted
    assert sorted(r.id for r in months(spark, path).schema(schema).load().collect()) == [3, 5, 6]


def test_landed_months_query(spark, sf_dir):
    first, hits = Counter(), Counter()
    for r in spark.read.parquet(f"{sf_dir}/clicks.parquet").collect():
        if r.ts is not None and r.arrived_at is not None:
            month = r.ts.strftime("%Y-%m")
            hits[month] += 1
            first[month] += r.arrived_at.strftime("%Y-%m") <= month
    got = {r.month: (r.n_first, r.hits, r.truncated, r.n, r.n_streamed) for r in QUERIES["landed_months"](spark, sf_dir).collect()}
    assert got == {m: (first[m], n, first[m] < n, n, n) for m, n in hits.items()}


def test_variants(spark):
    texts = ['{"k": 1, "x": [1]}', '{"K": "2", "x": {"y": 1}}', '{"k": "no"}', "[1]", "broken", None, "{}", '{"x": null, "k": 4.0}']
    rows = variants.opened(spark.createDataFrame([(t,) for t in texts], "t string"), "t")
    assert [r[0] for r in rows.select(variants.field("record", "bigint", "$.k", "$.K")).collect()] == [1, 2, None, None, None, None, None, 4]
    got = {(r.field, r.kind): r.n for r in variants.unseen_fields(rows, "record", ["k"]).collect()}
    assert got == {("x", "ARRAY"): 1, ("x", "OBJECT"): 1, ("x", "VOID"): 1, ("K", "STRING"): 1}


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names}


def test_parts(spark, tmp_path):
    path, schema = f"{tmp_path}/table", "id int, yr int, title string"
    rows = [(1, 2001, "a"), (2, 2001, "a"), (2, 2001, "a"), (3, 2002, None), (4, None, "z")]
    write = lambda rows: parts.write_parts(spark.createDataFrame(rows, schema), path, "yr")
    content = lambda **k: sorted((tuple(r) for r in parts.read_parts(spark, path, shape, **k).collect()), key=str)
    shape = spark.createDataFrame([], schema).schema
    assert content() == []
    assert write(rows) == {"written": ["=2001", "=2002", "null"], "kept": [], "removed": []}
    assert content() == sorted(rows, key=str) and content(parts=[None]) == [(4, None, "z")]
    before = files(path)
    assert write(rows[::-1]) == {"written": [], "kept": ["=2001", "=2002", "null"], "removed": []} and files(path) == before
    changed = [(1, 2001, "b"), (3, 2002, None), (5, 2003, "n")]
    assert write(changed) == {"written": ["=2001", "=2003"], "kept": ["=2002"], "removed": ["null"]}
    assert content() == changed
    assert not any("__part=2" in f for f in files(path) if f in before)  # the folder of the part that went
    assert write([]) == {"written": [], "kept": [], "removed": ["=2001", "=2002", "=2003"]} and content() == []
    assert json.loads(json.dumps(parts.manifest(spark, path)[1])) == {}


def test_parts_rewritten(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.year("o_orderdate").alias("yr")).collect()
    n = Counter(r.yr for r in rows)
    got = {r.yr: (r.times, r.n) for r in QUERIES["parts_rewritten"](spark, sf_dir).collect()}
    assert got == {y: (2 if y == max(n) else 1, 0 if y == min(n) else k) for y, k in n.items()}
