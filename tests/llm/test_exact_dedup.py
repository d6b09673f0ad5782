import glob
import hashlib
import os
from collections import defaultdict

import duckdb

from archivolt.llm.common import by_bucket, drop_stored, stored_in_buckets
from archivolt.llm.exact_dedup import _KEY, OP6_SQL, exact_duplicates, merge_pair, op6_exact_dedup


def brute(rows):
    norm = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append((-len(t or ""), i))
    return sorted(
        (i, min(groups[norm(t)])[1], len(groups[norm(t)]), min(groups[norm(t)])[1] == i, hashlib.sha256(norm(t).encode()).hexdigest())
        for i, t in rows
    )


def test_matches_brute_force_over_many_runs(spark):
    rows = [(i, t) for i, t in enumerate(["a b", "ab", "a  b", None, "", " \n", "é", "É", "a b", "ab\x0b\x0c", "x" * 50_000, "ab", "\xa0ab"] * 4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for parts, n_runs in ((1, 8), (13, 8), (13, 3), (5, 1)):
        got = exact_duplicates(docs.repartition(parts), n_runs=n_runs).collect()
        assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == brute(rows)


def test_query_matches_sql(spark, sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    got = op6_exact_dedup(spark, sf_dir)
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(con.execute(OP6_SQL).fetchall())


def test_merging_two_runs_neither_exchanges_nor_sorts(spark):
    def run(low, high):
        rows = spark.range(low, high).selectExpr(
            "unhex(sha2(string(id), 256)) AS digest", "id AS check", "1 AS n_norm", "struct(-1 AS rank, id + 1000 AS doc_id) AS best", "2L AS group_size"
        )
        return stored_in_buckets(rows.repartition(buckets, *_KEY), "digest-run", _KEY, buckets)

    with by_bucket(spark, 8) as buckets:
        a, b = run(0, 60), run(40, 100)
        merged = merge_pair(a, b)
        plan = merged._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
        got = {r.check: (r.best.doc_id, r.group_size) for r in merged.collect()}
    assert got == {k: (k + 1000, 4 if 40 <= k < 60 else 2) for k in range(100)}
    for run_ in (a, b):
        drop_stored(run_)


def test_edges(spark):
    rows = [(7, "t", 1), (7, "t", 2), (None, "t", 3), (3, "u", 4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, group_size int")
    got = sorted(((r.doc_id or 0), r.keep_id or 0, r.group_size, r.kept) for r in exact_duplicates(docs).collect())
    assert got == [(0, 0, 3, True), (3, 3, 1, True), (7, 0, 3, False), (7, 0, 3, False)]
    assert exact_duplicates(docs.limit(0)).collect() == []
