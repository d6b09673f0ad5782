import datetime as dt

import duckdb

from archivolt.llm.url_filter import OP3_SQL, filter_urls, op3_url_filter, validity


def test_entries_in_force_at_fetch_time(spark):
    day = lambda n: dt.date(2024, 1, n)
    entries = spark.createDataFrame(
        [("bad.org", day(5), "block"), ("bad.org", day(10), "allow"), ("bad.org", day(10), "block"), ("bad.org", day(20), "allow"),
         ("x.bad.org", day(6), "allow"), ("x.bad.org/a", day(8), "block"), (None, day(1), "block"), ("ok.net", None, "block")],
        "key string, listed date, action string",
    )
    rows = [
        (1, "http://bad.org/", day(4), "none"), (2, "http://bad.org/", day(5), "block"), (3, "https://BAD.org:80/q?x", day(19), "block"),
        (4, "http://bad.org", day(20), "allow"), (5, "http://x.bad.org/b", day(9), "allow"), (6, "http://u@x.bad.org/a/b#f", day(9), "block"),
        (7, None, day(9), "none"), (8, "no url", day(9), "none"), (9, "http://bad.org/", None, "none"), (2, "http://bad.org/", day(5), "block"),
        (10, "http://notbad.org/", day(9), "none"), (11, "http://ok.net/", day(9), "none"),
    ]
    captures = spark.createDataFrame(rows, "page_id bigint, url string, fetched date, verdict string")
    got = [(r.page_id, r.verdict) for r in filter_urls(captures, entries).collect()]
    assert sorted(got) == sorted((i, v) for i, _, _, v in rows)
    assert filter_urls(captures.limit(0), entries).collect() == []
    assert {r.verdict for r in filter_urls(captures, entries.limit(0)).collect()} == {"none"}


def test_validity_is_gapless_and_disjoint(spark):
    rows = [("k", dt.date(2024, 1, d), a) for d, a in ((3, "block"), (1, "allow"), (9, "allow"))]
    got = sorted(tuple(r) for r in validity(spark.createDataFrame(rows, "key string, listed date, action string")).collect())
    assert [(r[1].day, r[2] and r[2].day) for r in got if r[1].day < 9] == [(1, 3), (3, 9)] and len(got) == 3


def test_query_matches_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    columns = ["page_id", "url", "fetched", "verdict", "list_key", "listed_since"]
    got = op3_url_filter(spark, sf_dir).select(columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({OP3_SQL})").fetchall(), key=str)
    assert any(r.list_key and r.list_key.count("/") >= 2 for r in got)


def test_hosts_of_one_label(spark):
    day = dt.date(2024, 1, 1)
    entries = spark.createDataFrame([("localhost", day, "block"), ("intra/a/b", day, "block")], "key string, listed date, action string")
    rows = [("http://localhost/x", "block"), ("http://localhost", "block"), ("http://intra/a/b/c", "block"), ("http://intra/a", "none"), ("http:///a", "none")]
    got = filter_urls(spark.createDataFrame([(u, day) for u, _ in rows], "url string, fetched date"), entries)
    assert {r.url: r.verdict for r in got.collect()} == dict(rows)
