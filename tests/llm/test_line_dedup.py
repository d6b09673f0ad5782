import glob
import os

import duckdb
import pytest

from archivolt.llm.common import by_bucket, drop_stored
from archivolt.llm.line_dedup import OP7_SQL, LineRuns, drop_repeated_lines, op7_line_dedup
from tests.llm.test_pipeline import brute_lines


@pytest.mark.parametrize(("batches", "fan_in"), [(1, 2), (5, 2), (6, 3)])
def test_batches_and_levels_match_brute_force(spark, batches, fan_in):
    lines = ["A common line here", " a COMMON line here\t", "short", "only in one", "the same, twice", "é" * 9, "é" * 10, ""]
    docs = {i: "\n".join(lines[(i * k) % 8] for k in range(i % 7 + 1)) for i in range(40)} | {40: None, 41: "", 42: "\n\n", 43: "the same, twice\nthe same, twice"}
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").repartition(3)
    out = {r.doc_id: r for r in drop_repeated_lines(df, batches, fan_in).collect()}
    want = brute_lines(docs)
    assert {i: r.text for i, r in out.items()} == want
    for i, r in out.items():
        assert r.n_lines == (docs[i] or "").count("\n") + 1


def test_query_matches_sql(spark, sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    columns = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    got = op7_line_dedup(spark, sf_dir).select(columns).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(OP7_SQL).fetchall())


def test_edges(spark):
    rows = [(None, "a line of text\nx", 1), (1, "a line of text", 2), (2, "A LINE OF TEXT \ny", 3), (2, "z\na line of text", 3), (3, "w" * 60_000, 4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, owner int")
    got = {(r.doc_id, r.text[:20]) for r in drop_repeated_lines(docs).collect()}
    assert got == {(None, "a line of text\nx"), (1, "a line of text"), (2, "y"), (2, "z"), (3, "w" * 20)}
    assert drop_repeated_lines(docs.limit(0)).collect() == []


def test_ids_of_any_type(spark):
    rows = [(f"d{k:02}", f"line number {k % 7} of text\nmine {k} alone here") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = {r.doc_id: r.text for r in drop_repeated_lines(docs, 5).collect()}
    assert got == brute_lines(dict(rows))


def test_runs_stay_sorted_and_merge_without_exchange(spark):
    runs = LineRuns(spark)
    rows = [spark.range(k, 2000, 2).selectExpr("id * 7919 % 2003 AS h1", "id AS h2", "id AS owner") for k in (0, 1)]
    a, b = (runs.write(r.repartition(runs.buckets, "h1", "h2"), "run") for r in rows)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        with by_bucket(spark, runs.buckets):
            anti = a.join(b, ["h1", "h2"], "left_anti")
            plan = anti._jdf.queryExecution().executedPlan().toString()
            assert anti.count() == 1000 and "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
            runs.add(a)
            runs.add(b)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    (merged,) = runs.all()
    assert sorted(r.owner for r in merged.collect()) == list(range(2000))
    drop_stored(merged)
