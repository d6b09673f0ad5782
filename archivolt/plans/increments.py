"""Queries of page items by lateral join, of slices that close by timers, of mergeable counts and of observed writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from archivolt.functions import dates as D
from archivolt.functions import text as X
from archivolt.operators import marts as M
from archivolt.plans.views import article_author, headlines, read, records, sql
from archivolt.sources import archive as A
from archivolt.sources.pages import page_items
from archivolt.sources.shared import new_folder, written
from archivolt.streaming import timers

QUERIES, ORACLES = {}, {}


def query(text: str | None = None):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, text
        return f

    return add


@query()
def page_items_lateral(spark, sf):
    """The paragraphs of every page's article, by the table function, with their first links, first quoted headlines and the dates
    they refer to. Pages have no dates: theirs are derived from their numbers. SQL has no such parser; tests build whole trees."""
    pages = read(spark, sf, "pages", "page_id", "html")
    items = page_items(pages, "html", article=r"(?:https?://[^/]+)?(/[^?#\s]+)")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 366).cast("int"))
    return items.select("page_id", "no", "text", "link", X.quoted_headline(F.col("text")).alias("headline"), D.reference_date(F.col("text"), day).alias("refers_to"))


_ARRIVALS = 3


@query("""WITH c AS (SELECT CAST(ts AS DATE) AS day, arrived_at, CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 30 HOUR AS closes FROM clicks WHERE ts IS NOT NULL AND arrived_at IS NOT NULL),
z AS (SELECT max(arrived_at) AS z FROM c)
SELECT strftime(day, '%Y-%m-%d') AS day, count(*) FILTER (arrived_at < closes) AS n, count(*) FILTER (arrived_at >= closes) AS n_late FROM c, z WHERE closes < z GROUP BY 1""")
def stream_closed_days(spark, sf):
    """Clicks by day, as they stood when the day closed six hours after its end, and how many came later. They land in thirds of
    the time of arrival, and one checkpoint resumes after each."""
    clicks = read(spark, sf, "clicks", "click_id", "ts", "arrived_at")
    a, z = clicks.agg(F.min("arrived_at"), F.max("arrived_at")).first()
    base = new_folder(spark, "closing")
    step = (z - a) / _ARRIVALS if a is not None else None
    for k in range(_ARRIVALS):
        own = clicks if step is None else clicks.where((F.col("arrived_at") > F.lit(a + k * step)) if k else F.lit(True))
        own = own if step is None or k == _ARRIVALS - 1 else own.where(F.col("arrived_at") <= F.lit(a + (k + 1) * step))
        own.write.mode("append").parquet(f"{base}/landed")
        stream = spark.readStream.schema(clicks.schema).parquet(f"{base}/landed")
        timers.resume(timers.closing_days(stream, "ts", "arrived_at", F.col("click_id")), f"{base}/out", f"{base}/checkpoint")
    out = spark.read.schema("slice date, kind string, n long").option("recursiveFileLookup", True).parquet(f"{base}/out")
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0))
    return out.groupBy(F.date_format("slice", "yyyy-MM-dd").alias("day")).agg(of("closed").alias("n"), of("refetch").alias("n_late"))


@query(sql("author record", """
SELECT yr, count(DISTINCT author) AS n, true AS within FROM author JOIN record USING (article_id) GROUP BY yr"""))
def reporter_sketches(spark, sf):
    """Distinct authors by year from stored sketches of months, beside the exact count: whether it lies within the bounds."""
    rows = article_author(spark, sf).join(records(spark, sf).select("article_id", "yr", "mon"), "article_id")
    months = written(M.distinct_sketches(rows, ["yr", "mon"], "author"), "sketches")
    exact = M.distinct_by(rows, ["yr"], "author")
    both = M.merged_distinct(months, ["yr"]).join(exact, "yr")
    return both.select("yr", F.col("n_distinct").alias("n"), F.col("n_distinct").between(F.col("low"), F.col("high")).alias("within"))


@query(sql("record headline", """
SELECT count(*) AS n, count(*) FILTER (word_count = 0) AS n_zero, count(*) FILTER (coalesce(trim(headline), '') = '') AS n_untitled, CAST(sum(word_count) AS BIGINT) AS words
FROM record LEFT JOIN headline USING (article_id)"""))
def observed_write(spark, sf):
    """Records written once, with what is observed on the way: rows, rows without words and without a headline, and words."""
    rows = records(spark, sf).join(headlines(spark, sf), "article_id", "left")
    metrics = {
        "n": F.count(F.lit(1)), "n_zero": F.count_if(F.col("word_count") == 0), "n_untitled": F.count_if(F.coalesce(F.trim("headline"), F.lit("")) == ""),
        "words": F.sum(F.col("word_count").cast("long")),
    }
    holds = {"too many records have no words": lambda m: 10 * m["n_zero"] <= m["n"], "too many have no headline": lambda m: 2 * m["n_untitled"] <= m["n"]}
    found = A.write_observed(rows, new_folder(spark, "observed"), metrics, holds)
    return spark.createDataFrame([tuple(found[k] for k in metrics)], ", ".join(f"{k} long" for k in metrics))
