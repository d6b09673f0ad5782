"""Queries whose result is by row, on rows that share what the tables keep apart."""

import duckdb

from archivolt.plans.catalogue import ORACLES, QUERIES
from archivolt.plans.joins import read


def by_sql(name, **tables):
    con = duckdb.connect()
    for table, path in tables.items():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/*.parquet'")
    return sorted(con.execute(ORACLES[name]).fetchall(), key=str)


def test_pages_of_one_url_are_cached_each_by_itself(spark, tmp_path):
    long, short = "x" * 6000, "x" * 10
    pages = [(1, "u", long), (2, "u", short), (3, "u", long), (13, None, long), (4, None, long), (5, None, short), (6, "v", None), (None, "w", long), (None, "w", short),
             (7, "z", long), (7, "z", short)]
    path = f"{tmp_path}/pages.parquet"
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(path)
    got = QUERIES["cache_slug"](spark, str(tmp_path)).select("page_id", "cache_key").collect()
    want = by_sql("cache_slug", pages=path)
    assert sorted(map(tuple, got), key=str) == want and len(want) == 6
    assert read(spark, str(tmp_path), "pages").count() == len(pages)
