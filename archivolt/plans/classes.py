"""Queries of classification, features and serving."""

from __future__ import annotations

from pyspark.sql import functions as F

from archivolt.operators import classify as C
from archivolt.operators import marts as M
from archivolt.plans.views import headlines, read, records, sql

QUERIES, ORACLES = {}, {}


def query(text: str | None = None):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, text
        return f

    return add


def _reclassified(rows):
    k = F.col("article_id")
    section = F.when(F.col("section") == "1-URGENT", "Corrections").when(F.col("section") == "2-HIGH", "New York").otherwise(F.col("section"))
    headline = F.when(k % 11 == 0, "Primary Election Results").when(k % 7 == 0, "Winning Lottery Numbers").otherwise("News")
    material = F.when(k % 13 == 0, "Obituary").when(k % 5 == 0, "Quote").otherwise("News")
    authors = F.when(k % 2 == 1, F.array(F.lit("Jo Roe"))).otherwise(F.array(F.lit("The Wire")))
    signed = rows.select(k, section.alias("section"), headline.alias("headline"), material.alias("material"), authors.alias("authors"))
    return C.reclassify(signed, ["The Wire"]).select(k, "section", "is_lottery", "is_election")


@query(sql("record", r"""
SELECT article_id, CASE WHEN article_id % 13 = 0 THEN 'Obituaries'
  WHEN section = 'Corrections' AND article_id % 5 = 0 THEN 'Today''s Paper' WHEN section = 'New York' AND article_id % 7 = 0 AND article_id % 11 <> 0 THEN 'Today''s Paper'
  WHEN article_id % 11 = 0 AND article_id % 2 = 0 THEN 'Today''s Paper' ELSE section END AS section,
  section = 'New York' AND article_id % 7 = 0 AND article_id % 11 <> 0 AS is_lottery, article_id % 11 = 0 AND article_id % 2 = 0 AS is_election
FROM (SELECT article_id, CASE WHEN section = '1-URGENT' THEN 'Corrections' WHEN section = '2-HIGH' THEN 'New York' ELSE section END AS section FROM record)"""))
def ordered_reclassification(spark, sf):
    """The ordered rules over records that carry their signs by rules of the id; where two headlines meet, the election one
    goes before the lottery one."""
    return _reclassified(records(spark, sf))


@query("""WITH p AS (SELECT page_id, url, CASE page_id % 4 WHEN 0 THEN 'Correction' WHEN 1 THEN 'Quote' WHEN 2 THEN 'News' ELSE NULL END AS m, page_id % 3 AS s FROM pages)
SELECT 'http://h/' || CASE WHEN page_id % 10 = 9 THEN 'no-corrections-' ELSE 'corrections-' END || page_id % 50 AS url, min(page_id) AS day FROM p
WHERE page_id % 10 <> 9 AND (m = 'Correction' OR (s = 0 AND coalesce(m, '') <> 'Quote')) GROUP BY 1""")
def correction_page_urls(spark, sf):
    k = F.col("page_id")
    slug = F.when(k % 10 == 9, "no-corrections-").otherwise("corrections-")
    material = F.element_at(F.array(F.lit("Correction"), F.lit("Quote"), F.lit("News"), F.lit(None)), (k % 4 + 1).cast("int"))
    rows = read(spark, sf, "pages", "page_id").select(
        F.concat(F.lit("http://h/"), slug, (k % 50).cast("string")).alias("url"), material.alias("material"),
        F.when(k % 3 == 0, "Corrections").otherwise("News").alias("section"), k.alias("day"), F.lit("h").alias("headline"),
    )
    return C.correction_pages(rows).select("url", "day")


@query("""WITH d AS (SELECT user_id AS name, event_id AS id, event_type = 'error' AS rep, ts AS day, value FROM events),
w AS (SELECT *, count(*) FILTER (NOT rep) OVER (PARTITION BY name) AS o, row_number() OVER (PARTITION BY name ORDER BY rep, -value, id) AS r,
  row_number() OVER (PARTITION BY name ORDER BY day, CAST(id AS VARCHAR)) AS d FROM d),
f AS (SELECT *, CASE WHEN o > 0 THEN r = 1 ELSE d = 1 END AS first FROM w),
l AS (SELECT name, count(*) FILTER (rep AND NOT first) AS n FROM f GROUP BY name)
SELECT id, CASE WHEN first THEN n ELSE 0 END AS n_later FROM f JOIN l USING (name) WHERE NOT (rep AND NOT first)""")
def republication_merge(spark, sf):
    """Events of one user, errors as republications."""
    rows = read(spark, sf, "events").select(
        F.col("user_id").alias("name"), F.col("event_id").alias("id"), (F.col("event_type") == "error").alias("republished"),
        F.col("ts").alias("day"), "value", F.col("event_id").cast("string").alias("url"),
    )
    out = C.attach_republished(rows, "name", [-F.col("value"), F.col("id")])
    return out.select("id", F.size("later").cast("long").alias("n_later"))


@query(sql("headline record", """ SELECT article_id AS id, headline AS h, strftime(pub_date, '%Y-%m') AS m, CASE WHEN material = 'P' THEN 'y' END AS fp
FROM headline JOIN record USING (article_id) WHERE contains(lower(headline), 'ring')"""))
def tracker_search(spark, sf):
    """A narrow serving table and a headline search over it."""
    rows = headlines(spark, sf).join(records(spark, sf), "article_id")
    rows = rows.select("article_id", "headline", F.date_format("pub_date", "yyyy-MM").alias("month"), F.when(F.col("material") == "P", "y").alias("front"))
    return C.search(C.serving(rows, {"article_id": "id", "headline": "h", "month": "m", "front": "fp"}), "h", "Ring")


@query(sql("record", """,
y AS (SELECT section, yr, CAST(sum(word_count) AS BIGINT) AS words, CAST(sum(word_count) FILTER (material = 'O') AS BIGINT) AS blog, min(pub_date) AS a, max(pub_date) AS b FROM record GROUP BY 1, 2),
e AS (SELECT *, min(a) OVER (PARTITION BY section) AS first, max(b) OVER (PARTITION BY section) AS last FROM y),
d AS (SELECT *, CASE WHEN year(first) = year(last) THEN date_diff('day', first, last) + 1 WHEN yr = year(first) THEN date_diff('day', first, make_date(yr, 12, 31)) + 1
  WHEN yr = year(last) THEN date_diff('day', make_date(yr, 1, 1), last) + 1 END AS days FROM e),
s AS (SELECT *, CASE WHEN days IS NULL THEN words ELSE CAST(round_even(words * 365 / days, 0) AS BIGINT) END AS words_annual FROM d)
SELECT section, yr, words, words_annual, CASE WHEN words > 0 AND blog > 0 THEN CAST(round_even(words_annual * blog / words, 0) AS BIGINT) ELSE 0 END AS blog_scaled FROM s"""))
def rescaled_parts(spark, sf):
    """Parts of a total by the factor that annualised it: the edge years of a section are annualised, inner ones stay."""
    rows = records(spark, sf)
    year = M.annualised(rows, "section", "pub_date", "word_count")
    blog = rows.groupBy("section", "yr").agg(F.sum(F.when(F.col("material") == "O", F.col("word_count").cast("long"))).alias("blog"))
    out = C.rescale(year.join(blog, ["section", "yr"]), "words", "words_annual", ["blog"])
    return out.select("section", "yr", "words", "words_annual", "blog_scaled")


@query(sql("author headline record", """,
own AS (SELECT article_id, author, yr, pub_date FROM headline JOIN author USING (article_id) JOIN record USING (article_id) WHERE starts_with(headline, 'red ')),
r AS (SELECT DISTINCT article_id, yr, pub_date FROM own)
SELECT 'year' AS part, CAST(yr AS VARCHAR) AS key, count(*) AS n FROM r GROUP BY yr
UNION ALL SELECT * FROM (SELECT 'author', author, count(*) AS n FROM own GROUP BY author ORDER BY n DESC, author LIMIT 15)
UNION ALL SELECT * FROM (SELECT 'recent', CAST(article_id AS VARCHAR), 1 FROM r ORDER BY pub_date DESC, article_id LIMIT 50)"""))
def feature_report(spark, sf):
    from archivolt.plans.views import article_author

    rows = article_author(spark, sf).join(headlines(spark, sf), "article_id").join(records(spark, sf), "article_id")
    return M.feature_report(rows, F.col("headline").startswith("red "), "author", "yr", "pub_date", "article_id")
