"""The queries of whole tables; their twins are compared in test_queries."""

import pytest

from archivolt.plans.catalogue import QUERIES
from archivolt.plans.joins import read


def test_band_match_reads_whole_texts(spark, tmp_path):
    far = "filler " * 100 + "the quick brown passage of an item that stands far inside of the text"
    begin = "the quick brown passage of an item"
    docs = [(1, far), (2, begin + " goes elsewhere altogether"), (3, "nothing in common")]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, "The quick brown passage of an item that stands far inside")]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = QUERIES["band_match_top1"](spark, str(tmp_path)).collect()
    assert [(r.item_id, r.doc_id, r.inside, r.score) for r in got] == [(1, 1, True, 1.0)]


@pytest.mark.parametrize("name, table, key, found", [
    ("fallback_key_join", "part", "p_partkey", "p_partkey"), ("ordered_reclassification", "orders", "o_orderkey", "article_id"),
])
def test_every_row_has_its_result(spark, sf_dir, name, table, key, found):
    got = QUERIES[name](spark, sf_dir).select(found).collect()
    assert sorted(r[0] for r in got) == sorted(r[0] for r in read(spark, sf_dir, table, key).collect())


def test_every_event_is_merged(spark, sf_dir):
    got = QUERIES["republication_merge"](spark, sf_dir).selectExpr("count(*) + sum(n_later)").first()[0]
    assert got == read(spark, sf_dir, "events").count()


def test_every_year_is_rescaled(spark, sf_dir):
    years = {r.yr for r in QUERIES["rescaled_parts"](spark, sf_dir).collect()}
    assert years == {r[0] for r in read(spark, sf_dir, "orders").selectExpr("year(o_orderdate)").collect()}
