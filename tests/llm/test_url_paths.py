import datetime as dt

from archivolt.llm.url_filter import filter_urls


def test_entries_of_deep_paths(spark):
    day = dt.date(2024, 1, 1)
    entries = [("a.org", day, "allow"), ("a.org/x/y/z", day, "block"), ("a.org/x/y/z/1/2/3", day, "allow")]
    rows = [("http://a.org/x/y", "allow"), ("http://a.org/x/y/z/w", "block"), ("http://a.org/x/y/z/1/2/3/4?q", "allow"), ("http://a.org/x/y/zz", "allow")]
    captures = spark.createDataFrame([(u, day) for u, _ in rows], "url string, fetched date")
    got = filter_urls(captures, spark.createDataFrame(entries, "key string, listed date, action string"))
    assert {r.url: r.verdict for r in got.collect()} == dict(rows)
