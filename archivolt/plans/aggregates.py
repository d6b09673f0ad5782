"""Aggregation queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from archivolt.operators import marts as M
from archivolt.plans.views import article_author, article_subject, articles, headlines, read, records, sql

QUERIES, ORACLES = {}, {}


def query(text: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, text
        return f

    return add


_HALF = "CAST(round_even({}, 0) AS BIGINT)"


@query(sql("record", f""",
span AS (SELECT min(yr) AS a, max(yr) AS b FROM record),
cells AS (SELECT section, CAST(y AS INT) AS yr FROM (SELECT DISTINCT section FROM record), span, range(2100) r(y) WHERE y BETWEEN a AND b),
g AS (SELECT section, yr, count(*) AS n, {_HALF.format('sum(word_count) / count(*)')} AS a,
  {_HALF.format('median(word_count) FILTER (word_count > 0)')} AS m FROM record GROUP BY ALL)
SELECT c.section, c.yr, CAST(coalesce(n, 0) AS BIGINT) AS n, coalesce(a, 0) AS avg_words, coalesce(m, 0) AS median_words
FROM cells c LEFT JOIN g ON c.section = g.section AND c.yr = g.yr"""))
def section_year_trend(spark, sf):
    return M.trend(records(spark, sf), "section", "yr", "word_count")


_KINDS = """CASE WHEN material = 'O' THEN 'blog' WHEN section = '5-LOW' THEN 'podcast' ELSE 'standard' END"""


@query(sql("record", f""",
k AS (SELECT yr, mon, word_count AS w, {_KINDS} AS k FROM record)
SELECT yr, mon, count(*) AS n, CAST(sum(w) AS BIGINT) AS words,
""" + ",\n".join(f"count(*) FILTER (k = '{k}') AS n_{k}, CAST(coalesce(sum(w) FILTER (k = '{k}'), 0) AS BIGINT) AS words_{k}"
                 for k in ("blog", "podcast", "standard")) + " FROM k GROUP BY yr, mon"))
def monthly_bucket_counts(spark, sf):
    kinds = {"blog": F.col("material") == "O", "podcast": F.col("section") == "5-LOW"}
    return M.bucketed(records(spark, sf), ["yr", "mon"], "word_count", kinds, "standard")


@query(sql("record", """,
y AS (SELECT yr, CAST(floor(median(word_count)) AS BIGINT) AS annual_median FROM record WHERE word_count > 0 GROUP BY yr)
SELECT r.yr, r.mon, count(*) AS n, any_value(annual_median) AS annual_median
FROM record r JOIN y ON r.yr = y.yr GROUP BY r.yr, r.mon"""))
def annual_median_broadcast(spark, sf):
    rows = records(spark, sf)
    years = rows.groupBy("yr").agg(F.floor(M.median(F.col("word_count"))).alias("annual_median"))
    months = rows.groupBy("yr", "mon").agg(F.count(F.lit(1)).alias("n"))
    return months.join(years, "yr").select("yr", "mon", "n", "annual_median")


@query(sql("record", """
SELECT section, yr, CAST(least(word_count // 200, 20) AS INT) AS bin, count(*) AS n FROM record WHERE word_count > 0 GROUP BY ALL"""))
def wordcount_hist21(spark, sf):
    return M.histogram(records(spark, sf), ["section", "yr"], "word_count")


@query(sql("record", f"""
SELECT section, count(*) AS n, CAST(sum(word_count) AS BIGINT) AS words,
  {_HALF.format('sum(word_count) / count(*) FILTER (word_count > 0)')} AS avg_words,
  round_even(100 * count(*) / (SELECT count(*) FROM record), 2) AS share FROM record GROUP BY section"""))
def section_totals(spark, sf):
    return M.shares(records(spark, sf), "section", "word_count")


@query(sql("record", """
SELECT coalesce(section, 'All Sections') AS section, coalesce(yr, 0) AS yr, count(*) AS n, CAST(sum(word_count) AS BIGINT) AS words
FROM record GROUP BY GROUPING SETS ((section, yr), (yr), (section), ())"""))
def grand_total_sets(spark, sf):
    rows = records(spark, sf)
    sets = rows.groupingSets([["section", "yr"], ["yr"], ["section"], []], "section", "yr")
    out = sets.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("word_count").cast("long")).alias("words"))
    return out.select(F.coalesce("section", F.lit("All Sections")).alias("section"), F.coalesce("yr", F.lit(0)).alias("yr"), "n", "words")


def _credits(spark, sf):
    """(author, article columns, n_authors); the count is a window over the article, whose rows are few."""
    names = article_author(spark, sf)
    counted = names.withColumn("n_authors", F.count(F.lit(1)).over(W.partitionBy("article_id")))
    return counted.join(records(spark, sf), "article_id")


_CREDITS = """,
credits AS (SELECT author, r.*, count(*) OVER (PARTITION BY article_id) AS n_authors FROM author JOIN record r USING (article_id))"""
_MART = f""",
m0 AS (SELECT author, count(*) AS n_articles, CAST(sum(word_count // n_authors) AS BIGINT) AS words,
  count(*) FILTER (word_count = 0) AS n_zero, count(*) FILTER (material = 'P') AS n_brief,
  CAST(coalesce(sum(word_count // n_authors) FILTER (material = 'P'), 0) AS BIGINT) AS words_brief,
  count(*) FILTER (n_authors > 1) AS n_shared, count(*) FILTER (n_authors = 1 AND word_count > 200) AS n_solo,
  min(pub_date) AS first_date, max(pub_date) AS last_date, count(DISTINCT yr) AS n_years FROM credits GROUP BY author),
mart AS (SELECT *, CASE WHEN n_articles - n_zero - n_brief <> 0
  THEN {_HALF.format('(words - words_brief) / (n_articles - n_zero - n_brief)')} ELSE 0 END AS avg_words FROM m0)"""


@query(sql("author record", _CREDITS + _MART + " SELECT * FROM mart"))
def author_mart(spark, sf):
    return M.author_mart(_credits(spark, sf), brief="P")


_TOP = """,
c AS (SELECT author, section, count(*) AS n FROM credits GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY n DESC, section) AS rn FROM c),
tops AS (SELECT author, max(section) FILTER (rn = 1) AS "primary", max(section) FILTER (rn = 2) AS secondary FROM o GROUP BY author)"""


@query(sql("author record", _CREDITS + _TOP + " SELECT * FROM tops"))
def author_primary_secondary(spark, sf):
    return M.primary_secondary(_credits(spark, sf), "author", "section")


@query(sql("author record", _CREDITS + _MART + _TOP + """
SELECT author, n_articles, n_shared, n_zero, avg_words, "primary",
  ((n_articles >= 5 AND n_shared / n_articles >= 0.75 AND n_zero / n_articles >= 0.05)
   OR (n_articles >= 20 AND n_zero / n_articles >= 0.95) OR (n_articles >= 5 AND n_shared / n_articles >= 0.9 AND avg_words < 700)
   OR (n_articles >= 5 AND "primary" = '1-URGENT')) AND n_solo < 20 AS likely_multimedia
FROM mart JOIN tops USING (author)"""))
def multimedia_flag(spark, sf):
    """The library's rule with limits that the tables can reach."""
    credits = _credits(spark, sf)
    both = M.author_mart(credits, brief="P").join(M.primary_secondary(credits, "author", "section"), "author")
    out = M.likely_multimedia(both, zero=0.05, few_words=700, audio=("1-URGENT",))
    return out.select("author", "n_articles", "n_shared", "n_zero", "avg_words", "primary", "likely_multimedia")


@query(sql("author record", _CREDITS + f""",
y AS (SELECT author, yr, CAST(sum(word_count) AS BIGINT) AS words, min(pub_date) AS a, max(pub_date) AS b FROM credits GROUP BY ALL),
s AS (SELECT *, min(a) OVER (PARTITION BY author) AS f, max(b) OVER (PARTITION BY author) AS l FROM y),
d AS (SELECT *, CASE WHEN year(f) = year(l) THEN date_diff('day', f, l) + 1
  WHEN yr = year(f) THEN date_diff('day', f, make_date(yr, 12, 31)) + 1
  WHEN yr = year(l) THEN date_diff('day', make_date(yr, 1, 1), l) + 1 END AS days FROM s)
SELECT author, yr, words, CASE WHEN days IS NULL THEN words ELSE {_HALF.format('words * 365 / days')} END AS words_annual FROM d"""))
def annualised_output(spark, sf):
    return M.annualised(_credits(spark, sf), "author", "pub_date", "word_count")


@query(sql("author record", _CREDITS + f""",
g AS (SELECT author, CAST(sum(word_count) AS BIGINT) AS words, date_diff('day', min(pub_date), max(pub_date)) AS d FROM credits GROUP BY author)
SELECT author, words, CASE WHEN d >= 90 THEN {_HALF.format('words / (d / 365.25::DOUBLE)')} ELSE 0 END AS words_per_year FROM g"""))
def tenure_words_per_year(spark, sf):
    return M.tenure_rate(_credits(spark, sf), "author", "pub_date", "word_count")


@query(sql("author", """,
p AS (SELECT a.author, b.author AS other, count(*) AS n FROM author a JOIN author b ON a.article_id = b.article_id AND a.author <> b.author GROUP BY ALL)
SELECT * FROM (SELECT author, other, n, CAST(row_number() OVER (PARTITION BY author ORDER BY n DESC, other) AS INT) AS rank FROM p) WHERE rank <= 10"""))
def coauthor_top10(spark, sf):
    pairs = M.pair_counts(article_author(spark, sf), "article_id", "author")
    return M.ranked(pairs, ["author"], [F.desc("n"), F.asc("other")], 10)


@query(sql("subject author", """,
cnt AS (SELECT subject, count(*) AS corpus_n FROM subject GROUP BY subject), docs AS (SELECT count(DISTINCT article_id) AS n_docs FROM subject),
rows_ AS (SELECT author, article_id, subject FROM author JOIN subject USING (article_id)),
own AS (SELECT author, subject, count(*) AS n FROM rows_ GROUP BY ALL), tot AS (SELECT author, count(DISTINCT article_id) AS n_key FROM rows_ GROUP BY 1),
l AS (SELECT author, subject, n, (n / n_key) / (corpus_n / n_docs) AS lift FROM own JOIN tot USING (author) JOIN cnt USING (subject), docs
  WHERE n >= greatest(2, ceil(0.03 * n_key)))
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY author ORDER BY n DESC, subject) AS INT) AS rank FROM l WHERE lift >= 1.3) WHERE rank <= 7"""))
def beats_lift_top7(spark, sf):
    subjects = article_subject(spark, sf)
    corpus = subjects.groupBy("subject").agg(F.count(F.lit(1)).alias("corpus_n"))
    n_docs = subjects.agg(F.count_distinct("article_id").alias("n_docs"))
    return M.lift(article_author(spark, sf).join(subjects, "article_id"), "author", "subject", corpus, n_docs, 1.3)


@query(sql("subject author", """
SELECT subject, author, count(*) AS n FROM subject JOIN author USING (article_id) GROUP BY ALL HAVING count(*) >= 3"""))
def subject_index_min3(spark, sf):
    both = article_subject(spark, sf).join(article_author(spark, sf), "article_id")
    return both.groupBy("subject", "author").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")


@query(sql("subject", """,
p AS (SELECT a.subject, b.subject AS other, count(*) AS n FROM subject a JOIN subject b ON a.article_id = b.article_id AND a.subject <> b.subject GROUP BY ALL)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY subject ORDER BY n DESC, other) AS INT) AS rank FROM p) WHERE rank <= 15"""))
def cooccur_top15(spark, sf):
    pairs = M.pair_counts(article_subject(spark, sf), "article_id", "subject")
    return M.ranked(pairs, ["subject"], [F.desc("n"), F.asc("other")], 15)


@query(sql("author record", """
SELECT section, yr, count(DISTINCT author) AS n_distinct FROM author JOIN record USING (article_id) GROUP BY ALL HAVING count(DISTINCT author) >= 3"""))
def unique_reporters_section_year(spark, sf):
    return M.distinct_by(article_author(spark, sf).join(records(spark, sf), "article_id"), ["section", "yr"], "author", 3)


@query(sql("article", """
SELECT place, region, yr, count(*) AS n, count(*) FILTER (material = 'O') AS n_blog FROM article GROUP BY ALL HAVING count(*) >= 5"""))
def place_year_trend(spark, sf):
    sums = [F.count(F.lit(1)).alias("n"), F.count_if(F.col("material") == "O").alias("n_blog")]
    return articles(spark, sf).groupBy("place", "region", "yr").agg(*sums).where("n >= 5")


@query(sql("article", """,
g AS (SELECT place, yr, count(*) FILTER (section = '1-URGENT') AS n_first, count(*) FILTER (section = '2-HIGH') AS n_second
  FROM article WHERE section IN ('1-URGENT', '2-HIGH') GROUP BY ALL),
k AS (SELECT place FROM article WHERE section = '1-URGENT' INTERSECT SELECT place FROM article WHERE section = '2-HIGH')
SELECT place, yr, n_first, n_second, place IN (SELECT place FROM k) AS in_both FROM g"""))
def state_section_split(spark, sf):
    rows = articles(spark, sf).where(F.col("section").isin("1-URGENT", "2-HIGH"))
    inside = lambda s: F.col("section") == s
    counts = rows.groupBy("place", "yr").agg(F.count_if(inside("1-URGENT")).alias("n_first"), F.count_if(inside("2-HIGH")).alias("n_second"))
    keys = rows.where(inside("1-URGENT")).select("place").intersect(rows.where(inside("2-HIGH")).select("place"))
    return counts.join(keys.withColumn("k", F.lit(True)), "place", "left").select(
        "place", "yr", "n_first", "n_second", F.coalesce("k", F.lit(False)).alias("in_both")
    )


_FEATURES = ["cold", "small", "red", "blue", "old", "hot", "large"]


@query(sql("headline record", """,
f AS (SELECT article_id, yr, CASE """ + " ".join(f"WHEN starts_with(headline, '{w} ') THEN '{w}'" for w in _FEATURES) + """ END AS feature
  FROM headline JOIN record USING (article_id))
SELECT feature, yr, count(*) AS n, min(article_id) AS first_id FROM f WHERE feature IS NOT NULL GROUP BY ALL"""))
def feature_first_match(spark, sf):
    """An ordered rule list: the first rule that matches names the feature."""
    rule = F.coalesce(*(F.when(F.col("headline").startswith(f"{w} "), F.lit(w)) for w in _FEATURES))
    rows = headlines(spark, sf).withColumn("feature", rule).where("feature IS NOT NULL").join(records(spark, sf), "article_id")
    return rows.groupBy("feature", "yr").agg(F.count(F.lit(1)).alias("n"), F.min("article_id").alias("first_id"))


@query(sql("author", """,
n AS (SELECT article_id, count(*) AS n FROM author GROUP BY 1), record AS (SELECT o_orderkey AS article_id, CAST(year(o_orderdate) AS INT) AS yr FROM orders)
SELECT yr, count(*) AS n_articles, count(*) FILTER (n > 1) AS n_multi, round_even(100 * count(*) FILTER (n > 1) / count(*), 1) AS share
FROM record JOIN n USING (article_id) GROUP BY yr"""))
def multi_byline_share(spark, sf):
    n = article_author(spark, sf).groupBy("article_id").agg(F.count(F.lit(1)).alias("n"))
    multi = F.count_if(F.col("n") > 1)
    return records(spark, sf).join(n, "article_id").groupBy("yr").agg(
        F.count(F.lit(1)).alias("n_articles"), multi.alias("n_multi"), F.bround(100 * multi / F.count(F.lit(1)), 1).alias("share")
    )


@query(sql("author record", """,
c AS (SELECT author FROM author JOIN record USING (article_id) WHERE section = '1-URGENT' AND yr IN (1996, 1998) GROUP BY author HAVING count(*) >= 20)
SELECT section, count(DISTINCT article_id) AS n FROM author JOIN record USING (article_id) WHERE yr = 1997 AND author IN (SELECT author FROM c) GROUP BY section"""))
def inferred_cohort_count(spark, sf):
    """Authors with 20 records of a section in the years beside a gap; their records in the gap year."""
    rows = article_author(spark, sf).join(records(spark, sf), "article_id")
    cohort = rows.where((F.col("section") == "1-URGENT") & F.col("yr").isin(1996, 1998)).groupBy("author").count().where("count >= 20")
    gap = rows.where("yr = 1997").join(cohort, "author", "left_semi")
    return gap.groupBy("section").agg(F.count_distinct("article_id").alias("n"))


@query(sql("subject record", """,
last AS (SELECT max(yr) AS y FROM record), rows_ AS (SELECT subject, yr FROM subject JOIN record USING (article_id), last WHERE yr < y),
big AS (SELECT subject FROM rows_ GROUP BY subject HAVING count(*) >= 15)
SELECT subject, yr, count(*) AS n FROM rows_ WHERE subject IN (SELECT subject FROM big) GROUP BY ALL"""))
def entity_year_min15(spark, sf):
    """Entity by year without the open year, entities of at least 15; one aggregation, the total is a window over it."""
    rows = records(spark, sf)
    last = rows.agg(F.max("yr").alias("y"))
    counts = article_subject(spark, sf).join(rows, "article_id").crossJoin(last).where("yr < y").groupBy("subject", "yr").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("t", F.sum("n").over(W.partitionBy("subject"))).where("t >= 15").drop("t")


_TERMS = {"n_red": r"\bred\b", "n_ring": r"\bring\b", "n_widget": r"\bwidget\b"}


@query(sql("headline record", """,
b AS (SELECT date_trunc('month', min(pub_date)) AS a, date_trunc('month', max(pub_date)) AS z FROM record),
m AS (SELECT CAST(x AS DATE) AS month FROM b, generate_series(a, z, INTERVAL 1 MONTH) t(x) WHERE x < z),
c AS (SELECT CAST(date_trunc('month', pub_date) AS DATE) AS month, headline AS h FROM record JOIN headline USING (article_id))
SELECT strftime(m.month, '%Y-%m') AS month, """ + ", ".join(rf"count(*) FILTER (regexp_matches(h, '{p}')) AS {c}" for c, p in _TERMS.items()) + """
FROM m LEFT JOIN c ON m.month = c.month GROUP BY m.month"""))
def regex_month_series(spark, sf):
    """Matches of each term by month, zero-filled, without the open month."""
    rows = records(spark, sf).withColumn("month", F.trunc("pub_date", "month"))
    spine = rows.agg(F.min("month").alias("a"), F.max("month").alias("z")).select(
        F.explode(F.sequence("a", F.add_months("z", F.lit(-1)), F.expr("interval 1 month"))).alias("month")
    )
    counts = headlines(spark, sf).join(rows, "article_id").groupBy("month").agg(
        *(F.count_if(F.col("headline").rlike(p)).alias(c) for c, p in _TERMS.items())
    )
    return spine.join(counts, "month", "left").select(F.date_format("month", "yyyy-MM").alias("month"), *(F.coalesce(c, F.lit(0)).alias(c) for c in _TERMS))


@query(sql("article author", """
SELECT count(*) AS n_articles, CAST(sum(word_count) AS BIGINT) AS words, count(DISTINCT section) AS n_sections,
  min(pub_date) AS first_date, max(pub_date) AS last_date, count(DISTINCT place) AS n_places FROM article"""))
def summary_scalars(spark, sf):
    return articles(spark, sf).agg(
        F.count(F.lit(1)).alias("n_articles"), F.sum(F.col("word_count").cast("long")).alias("words"),
        F.count_distinct("section").alias("n_sections"), F.min("pub_date").alias("first_date"),
        F.max("pub_date").alias("last_date"), F.count_distinct("place").alias("n_places"),
    )


@query(sql("author record", _CREDITS + _MART + """
SELECT author, n_articles, words FROM mart WHERE n_articles >= 25 ORDER BY n_articles DESC, author LIMIT 50"""))
def top_authors_50(spark, sf):
    mart = M.author_mart(_credits(spark, sf), brief="P")
    return mart.where("n_articles >= 25").orderBy(F.desc("n_articles"), "author").limit(50).select("author", "n_articles", "words")


@query(sql("author record", _CREDITS + _MART + """
SELECT author, avg_words FROM mart WHERE n_articles >= 30 ORDER BY avg_words DESC, author LIMIT 25"""))
def wordiest_authors_25(spark, sf):
    mart = M.author_mart(_credits(spark, sf), brief="P")
    return mart.where("n_articles >= 30").orderBy(F.desc("avg_words"), "author").limit(25).select("author", "avg_words")


@query(sql("record", " SELECT article_id, pub_date, section FROM record WHERE material = 'P' ORDER BY pub_date DESC, article_id LIMIT 50"))
def recent_first_50(spark, sf):
    rows = records(spark, sf).where("material = 'P'").select("article_id", "pub_date", "section")
    return rows.orderBy(F.desc("pub_date"), "article_id").limit(50)


@query("""WITH o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i,
  count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, """ + ", ".join(f"max(value) FILTER (i = least(n - 1, CAST(floor({q} * n) AS BIGINT))) AS {c}" for c, q in
                                   (("p10", 0.1), ("p50", 0.5), ("p90", 0.9), ("p99", 0.99))) + " FROM o GROUP BY event_type")
def nearest_rank_percentiles(spark, sf):
    rows = read(spark, sf, "events", "event_type", "value")
    return M.nearest_rank(rows, "event_type", "value", {"p10": 0.1, "p50": 0.5, "p90": 0.9, "p99": 0.99})


@query(sql("article", """,
g AS (SELECT yr, place, count(*) AS n FROM article GROUP BY ALL), pop AS (SELECT n_name AS place, 1 + n_nationkey % 7 AS population FROM nation WHERE n_nationkey <> 3),
r AS (SELECT yr, g.place, n, n / population AS rate FROM g JOIN pop ON g.place = pop.place),
o AS (SELECT *, row_number() OVER (PARTITION BY yr ORDER BY rate, place) - 1 AS i, count(*) OVER (PARTITION BY yr) AS c FROM r)
SELECT yr, place, n, round(rate, 6) AS rate, CAST(least(5, i * 5 // c + 1) AS INT) AS quintile FROM o"""))
def per_capita_quintile(spark, sf):
    counts = articles(spark, sf).groupBy("yr", "place").agg(F.count(F.lit(1)).alias("n"))
    population = read(spark, sf, "nation").where("n_nationkey <> 3").select(F.col("n_name").alias("place"), (1 + F.col("n_nationkey") % 7).alias("population"))
    rates = counts.join(population, "place").withColumn("rate", F.col("n") / F.col("population"))
    ranked = M.quintile(rates, ["yr"], [F.asc("rate"), F.asc("place")])
    return ranked.select("yr", "place", "n", F.round("rate", 6).alias("rate"), "quintile")


@query(sql("record", """
SELECT section, round(quantile_cont(word_count, 0.97), 6) AS cap, round(quantile_cont(word_count, 0.2), 6) AS q20, round(quantile_cont(word_count, 0.4), 6) AS q40,
  round(quantile_cont(word_count, 0.6), 6) AS q60, round(quantile_cont(word_count, 0.8), 6) AS q80 FROM record WHERE word_count > 0 GROUP BY section"""))
def percentile_cap(spark, sf):
    q = F.percentile("word_count", [0.97, 0.2, 0.4, 0.6, 0.8])
    rows = records(spark, sf).where("word_count > 0").groupBy("section").agg(q.alias("q"))
    return rows.select("section", *(F.round(F.col("q")[i], 6).alias(c) for i, c in enumerate(("cap", "q20", "q40", "q60", "q80"))))


@query("""WITH a AS (SELECT o_orderpriority AS section, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1
UNION ALL SELECT o_orderpriority, count(*) FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
SELECT section, CAST(sum(n) AS BIGINT) AS n FROM a GROUP BY section""")
def counter_add(spark, sf):
    rows = records(spark, sf)
    part = lambda m: rows.where(F.col("material") == m).groupBy("section").agg(F.count(F.lit(1)).alias("n"))
    return part("O").unionByName(part("P")).groupBy("section").agg(F.sum("n").alias("n"))


@query(sql("author record", """,
w AS (SELECT author, sum(word_count) AS t FROM author JOIN record USING (article_id) WHERE material = 'P' GROUP BY author)
SELECT section, yr, author, count(*) AS n FROM author JOIN record USING (article_id)
WHERE author IN (SELECT author FROM w WHERE t > 30000) GROUP BY GROUPING SETS ((section, yr), (author, yr), (yr))"""))
def denominators_semi(spark, sf):
    """Denominators by section, author and all, limited by a semi join to authors that the other table knows."""
    rows = article_author(spark, sf).join(records(spark, sf), "article_id")
    # counted before the semi join and the sets, so that what moves by author are cells and not articles
    words = F.sum(F.when(F.col("material") == "P", F.col("word_count"))).alias("t")
    cells = rows.groupBy("section", "yr", "author").agg(F.count(F.lit(1)).alias("n"), words)
    known = cells.groupBy("author").agg(F.sum("t").alias("t")).where("t > 30000")
    kept = cells.join(known, "author", "left_semi")
    sets = kept.groupingSets([["section", "yr"], ["author", "yr"], ["yr"]], "section", "yr", "author")
    return sets.agg(F.sum("n").alias("n")).select("section", "yr", "author", "n")


@query("""SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum,
  count(DISTINCT user_id) AS n_users FROM events GROUP BY ALL""")
def json_props_rollup(spark, sf):
    k = F.from_json("props", "k bigint")["k"]
    return read(spark, sf, "events").groupBy("event_type", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(k).alias("k_sum"), F.count_distinct("user_id").alias("n_users")
    )
