"""Join, window, set and duplicate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from archivolt.functions import text as X
from archivolt.operators import marts as M
from archivolt.operators import matching as J
from archivolt.operators.marts import ranked
from archivolt.operators.prefixes import digest_of, prefix_relatives
from archivolt.plans.views import article_author, article_subject, articles, headlines, read, records, sql

QUERIES, ORACLES = {}, {}


def query(text: str | None = None):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, text
        return f

    return add


@query(sql("record", """
SELECT * FROM (SELECT yr, article_id, pub_date, CAST(row_number() OVER (PARTITION BY yr ORDER BY pub_date, article_id) AS INT) AS rank FROM record) WHERE rank <= 16"""))
def stratified_sample16(spark, sf):
    rows = records(spark, sf).select("yr", "article_id", "pub_date")
    return M.ranked(rows, ["yr"], [F.asc("pub_date"), F.asc("article_id")], 16)


#: A document's headline: its first line.
_DOC_KEY = "lower(trim(split_part(text, chr(10), 1)))"


@query(f"""WITH d AS (SELECT doc_id, {_DOC_KEY} AS k, n_chars AS n, source FROM documents WHERE text IS NOT NULL),
g AS (SELECT *, min(n) OVER w AS lo, max(n) OVER w AS hi, count(*) OVER w AS c,
  row_number() OVER (PARTITION BY k ORDER BY length(source), doc_id) AS rn FROM d WINDOW w AS (PARTITION BY k))
SELECT doc_id, k <> '' AND c > 1 AND hi > 0 AND lo >= 0.9 * hi AND rn > 1 AS is_duplicate FROM g""")
def dedup_90pct(spark, sf):
    docs = read(spark, sf, "documents", "doc_id", "text", "n_chars", "source").where("text IS NOT NULL")
    headline = F.lower(F.trim(F.split_part("text", F.lit("\n"), F.lit(1))))
    rows = docs.select("doc_id", headline.alias("k"), "n_chars", "source")
    return J.duplicates(rows, ["k"], "n_chars", "source", "doc_id").select("doc_id", "is_duplicate")


@query("""WITH l AS (SELECT *, lag(ts) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
c AS (SELECT *, sum(CASE WHEN b IS NULL OR ts - b > INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS chain FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, chain ORDER BY -value, length(event_type), event_id) AS rn, count(*) OVER (PARTITION BY user_id, chain) AS n FROM c)
SELECT user_id, CAST(chain AS BIGINT) AS chain, n, event_id AS representative FROM r WHERE rn = 1""")
def session_cluster_6h(spark, sf):
    """Chains of a user's events and the best event of each by a composite rank."""
    gap = F.col("__now") - F.col("__before") > F.expr("interval 6 hours")
    rows = J.chains(read(spark, sf, "events"), "user_id", F.col("ts"), gap, "event_id")
    best = F.min_by("event_id", F.struct(-F.col("value"), F.char_length("event_type"), F.col("event_id")))
    return rows.groupBy("user_id", "chain").agg(F.count(F.lit(1)).alias("n"), best.alias("representative"))


@query(sql("author record", """,
k AS (SELECT article_id, string_agg(author, '|' ORDER BY author) AS authors FROM author GROUP BY 1),
r AS (SELECT section, authors, article_id, pub_date, row_number() OVER w AS rn, count(*) OVER (PARTITION BY section, authors) AS n
  FROM k JOIN record USING (article_id) WINDOW w AS (PARTITION BY section, authors ORDER BY pub_date, article_id))
SELECT section, authors, max(article_id) FILTER (rn = 1) AS article_id, coalesce(string_agg(CAST(article_id AS VARCHAR), ',' ORDER BY rn) FILTER (rn > 1), '') AS later
FROM r GROUP BY section, authors"""))
def rollup_duplicates(spark, sf):
    """Records of one section and one set of authors: the earliest stays, the others fold into it."""
    authors = article_author(spark, sf).groupBy("article_id").agg(F.array_join(F.sort_array(F.collect_list("author")), "|").alias("authors"))
    rows = authors.join(records(spark, sf), "article_id")
    rolled = J.roll_up(rows, ["section", "authors"], ["pub_date", "article_id"], ["article_id"], "article_id")
    return rolled.withColumn("later", F.array_join(F.col("later").cast("array<string>"), ","))


_STOP = "('" + "','".join(X.STOP_WORDS) + "')"


@query(f"""WITH b AS (SELECT item_id, lower(text) AS t, DATE '2024-01-01' + CAST(item_id % 20 AS INT) AS d,
  list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: length(w) > 3 AND w NOT IN {_STOP})) AS bag FROM benchmark),
a AS (SELECT doc_id, lower(text) AS h, DATE '2024-01-01' + CAST(doc_id % 20 AS INT) AS d,
  list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: length(w) > 3 AND w NOT IN {_STOP})) AS bag FROM documents),
p AS (SELECT item_id, doc_id, date_diff('day', b.d, a.d) AS o, length(b.t) >= 6 AND contains(a.h, b.t) AS inside,
  len(list_intersect(b.bag, a.bag)) AS n, len(a.bag) AS size FROM b JOIN a ON a.d BETWEEN b.d - 3 AND b.d + 3),
s AS (SELECT *, n / least(greatest(size, 4), 8) AS score FROM p WHERE inside OR n > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY inside DESC, CASE WHEN inside THEN 0 ELSE score END DESC, o, doc_id) AS rn FROM s)
SELECT item_id, doc_id, CAST(o AS INT) AS "offset", inside, CASE WHEN inside THEN 1.0 ELSE round(score, 6) END AS score FROM r
WHERE rn = 1 AND (inside OR n >= 2 OR score = 1.0)""")
def band_match_top1(spark, sf):
    """Each item's best document within three days: its whole text inside the document's first, then shared words."""
    day = lambda c: F.date_add(F.to_date(F.lit("2024-01-01")), (F.col(c) % 20).cast("int")).alias("day")
    side = lambda name, c, k: read(spark, sf, name, c, "text").select(
        F.col(c).alias(k), day(c), X.token_bag("text", ascii_only=True).alias("words"), F.lower("text").alias("title")
    )
    best = J.best_match(side("benchmark", "item_id", "item"), side("documents", "doc_id", "partner"))
    return best.select(F.col("item").alias("item_id"), F.col("partner").alias("doc_id"), "offset", "inside", F.round("score", 6).alias("score"))


@query("""WITH d AS (SELECT doc_id, lower(trim(text)) AS t, CAST(2000 + doc_id % 3 AS INT) AS yr FROM documents WHERE length(trim(text)) >= 40),
p AS (SELECT a.doc_id, b.doc_id AS original, b.yr - a.yr AS off FROM d a JOIN d b ON a.doc_id > b.doc_id AND abs(b.yr - a.yr) <= 1
  AND (starts_with(a.t, b.t) OR starts_with(b.t, a.t))),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE off WHEN 0 THEN 0 WHEN -1 THEN 1 ELSE 2 END, original) AS rn FROM p)
SELECT doc_id, original, CAST(off AS INT) AS year_offset FROM r WHERE rn = 1""")
def prefix_year_match(spark, sf):
    """A republished text with its original: one is the other's prefix, within a year; the same year first, then the one
    before. Of each distinct text and year the first document is enough, and texts meet as sorted neighbours, not as pairs."""
    docs = read(spark, sf, "documents", "doc_id", "text").select(
        "doc_id", F.lower(F.trim("text")).alias("text"), (2000 + F.col("doc_id") % 3).cast("int").alias("yr")
    )
    docs = docs.where(F.char_length("text") >= 40).withColumn("digest", digest_of("text"))
    firsts = docs.groupBy("digest", "yr").agg(F.min("doc_id").alias("first"))
    years = firsts.groupBy("digest").agg(  # at most as many as there are years
        F.collect_list(F.struct(F.col("yr").alias("group"), F.col("first").alias("value"))).alias("known"),
        F.array_distinct(F.flatten(F.collect_list(F.array(F.col("yr") - 1, F.col("yr"), F.col("yr") + 1)))).alias("asked"),
    )
    texts = docs.groupBy("digest").agg(F.first("text").alias("text")).join(years, "digest")
    relatives = prefix_relatives(texts.select("text", "known", "asked"))
    asked = docs.select("doc_id", "digest", "yr", F.explode(F.array(*map(F.lit, (0, -1, 1)))).alias("year_offset"))
    found = asked.withColumn("group", (F.col("yr") + F.col("year_offset")).cast("long")).join(relatives, ["digest", "group"]).where("value < doc_id")
    rank = F.when(F.col("year_offset") == 0, 0).when(F.col("year_offset") == -1, 1).otherwise(2)
    best = found.groupBy("doc_id").agg(F.min_by(F.struct("value", "year_offset"), rank).alias("b"))
    return best.select("doc_id", F.col("b.value").alias("original"), "b.year_offset")


@query("""WITH u AS (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1),
i AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id END AS k FROM events)
SELECT event_id, o_orderkey FROM i JOIN u ON i.k = u.o_custkey""")
def inline_key_match(spark, sf):
    """Events with their user's last order: an equi-join whose right side keeps one record of each key; null keys never match."""
    orders = read(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    last = orders.groupBy(F.col("o_custkey").alias("k")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))
    items = read(spark, sf, "events", "event_id", "user_id").select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("user_id")).alias("k"))
    return items.join(last, "k").select("event_id", "o_orderkey")


@query("""WITH b AS (SELECT date_trunc('month', min(o_orderdate)) a, date_trunc('month', max(o_orderdate)) z FROM orders),
m AS (SELECT CAST(x AS DATE) AS month, z FROM b, generate_series(a, z, INTERVAL 1 MONTH) t(x)),
have AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
  GROUP BY 1 HAVING 100 * count(n) >= 98 * count(*))
SELECT strftime(month, '%Y-%m') AS month, month >= CAST(z - INTERVAL 2 MONTH AS DATE) AS refetch FROM m
WHERE month NOT IN (SELECT month FROM have) OR month >= CAST(z - INTERVAL 2 MONTH AS DATE)""")
def anti_missing_months(spark, sf):
    """Months to fetch: those of whose orders over one in fifty has no lines yet, and the last three always."""
    from archivolt.sources.archive import months_to_fetch

    orders = read(spark, sf, "orders", "o_orderkey", "o_orderdate")
    month = F.trunc("o_orderdate", "month").alias("month")
    lines = read(spark, sf, "lineitem", "l_orderkey").distinct()
    counted = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy(month).agg(F.count(F.lit(1)).alias("n"), F.count("l_orderkey").alias("there"))
    return months_to_fetch(orders.select(month), counted.where("100 * there >= 98 * n").select("month"))


@query("""WITH p AS (SELECT ps_key AS c_custkey, arg_max(seg, seq) FILTER (seg IS NOT NULL) AS seg FROM (
  SELECT o_custkey AS ps_key, o_orderkey AS seq, CASE WHEN o_orderstatus = 'P' THEN 'PATCHED-' || o_orderpriority END AS seg,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn = 1 GROUP BY 1)
SELECT c.c_custkey, coalesce(p.seg, c_mktsegment) AS c_mktsegment FROM customer c LEFT JOIN p USING (c_custkey)""")
def override_patch(spark, sf):
    patches = read(spark, sf, "orders", "o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority").select(
        F.col("o_custkey").alias("c_custkey"), "o_orderkey",
        F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("PATCHED-"), "o_orderpriority")).alias("c_mktsegment"),
    )
    rows = read(spark, sf, "customer", "c_custkey", "c_mktsegment")
    return J.patch(rows, patches, "c_custkey", [F.desc("o_orderkey")], ["c_mktsegment"])


@query("""SELECT p_partkey, unnest(string_split(p_name, ' ')) AS piece, generate_subscripts(string_split(p_name, ' '), 1) - 1 AS no, p_size FROM part""")
def split_explode(spark, sf):
    """One row into several: the parts of a split record, each with the record's other columns."""
    rows = read(spark, sf, "part", "p_partkey", "p_name", "p_size")
    return rows.select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("no", "piece"), "p_size").withColumn("no", F.col("no").cast("long"))


@query("""WITH h AS (SELECT s.p_partkey, t.p_partkey AS hit, 0 AS step FROM part s JOIN part t ON s.p_name = t.p_name AND s.p_brand = t.p_brand AND s.p_type = t.p_type AND s.p_partkey <> t.p_partkey
UNION ALL SELECT s.p_partkey, t.p_partkey, 1 FROM part s JOIN part t ON s.p_name = t.p_name AND s.p_brand = t.p_brand AND s.p_partkey <> t.p_partkey
UNION ALL SELECT s.p_partkey, t.p_partkey, 2 FROM part s JOIN part t ON s.p_brand = t.p_brand AND s.p_type = t.p_type AND s.p_partkey <> t.p_partkey),
r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY step, hit) AS rn FROM h)
SELECT s.p_partkey, coalesce(r.hit, -1) AS hit, CAST(coalesce(r.step, -1) AS INT) AS step FROM part s LEFT JOIN r ON s.p_partkey = r.p_partkey AND rn = 1""")
def fallback_key_join(spark, sf):
    """Every part with the first other one by ever weaker keys."""
    parts = read(spark, sf, "part", "p_partkey", "p_name", "p_brand", "p_type")
    other = parts.withColumnRenamed("p_partkey", "hit")
    keys = (["p_name", "p_brand", "p_type"], ["p_name", "p_brand"], ["p_brand", "p_type"])
    two = lambda k: ranked(other, k, [F.asc("hit")], 2, "__r").select(*k, "hit")  # noqa: E731  one of them may be the part itself
    steps = [parts.join(two(k), k).where("hit <> p_partkey").select("p_partkey", "hit") for k in keys]
    return J.fallback_join(parts.select("p_partkey"), "p_partkey", steps, [F.asc("hit")]).na.fill(-1, ["hit", "step"])


@query("""SELECT c_custkey, CAST(coalesce(sum(CAST(floor(o_totalprice / 100) AS INT)), 0) AS BIGINT) AS words
FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P' GROUP BY c_custkey""")
def default_left_join(spark, sf):
    words = read(spark, sf, "orders", "o_custkey", "o_orderstatus", "o_totalprice").where("o_orderstatus = 'P'")
    sums = words.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum(F.floor(F.col("o_totalprice") / 100)).alias("w"))
    return read(spark, sf, "customer", "c_custkey").join(sums, "c_custkey", "left").select("c_custkey", F.coalesce("w", F.lit(0)).alias("words"))


@query("""SELECT yr, sum(n)::BIGINT AS n FROM (SELECT year(o_orderdate)::INT AS yr, 1 AS n FROM orders WHERE year(o_orderdate) <> 1997
UNION ALL SELECT 1997, 1 FROM orders WHERE year(o_orderdate) = 1997 AND o_orderstatus <> 'F') GROUP BY yr""")
def slice_replace_union(spark, sf):
    """A slice of a table replaced by a new one: the others stay."""
    from archivolt.sources.archive import replace_slice

    rows = read(spark, sf, "orders", "o_orderdate", "o_orderstatus").withColumn("yr", F.year("o_orderdate"))
    new = rows.where("yr = 1997 AND o_orderstatus <> 'F'")
    return replace_slice(rows, new, "yr").groupBy("yr").agg(F.count(F.lit(1)).alias("n"))


@query(sql("subject record", """,
base AS (SELECT subject, count(*) AS freq FROM subject GROUP BY 1), docs AS (SELECT count(DISTINCT article_id) AS d FROM subject)
SELECT place, subject, yr, count(*) AS n FROM subject JOIN (SELECT o_orderkey AS article_id, n_name AS place, CAST(year(o_orderdate) AS INT) AS yr
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) USING (article_id) GROUP BY ALL"""))
def theme_place_tag(spark, sf):
    from archivolt.operators.themes import place_tags

    return place_tags(articles(spark, sf), article_subject(spark, sf))


@query("""WITH a AS (SELECT o_orderkey AS id, n_name AS place, CAST(year(o_orderdate) AS INT) AS yr FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
s AS (SELECT DISTINCT l_orderkey AS id, p_name AS tag FROM lineitem JOIN part ON l_partkey = p_partkey),
base AS (SELECT tag, count(*) AS freq FROM s JOIN a USING (id) GROUP BY 1), corpus AS (SELECT count(*) AS c FROM a),
t AS (SELECT place, count(*) AS total FROM a GROUP BY 1), y AS (SELECT place, tag, yr, count(*) AS n FROM a JOIN s USING (id) GROUP BY ALL),
pr AS (SELECT *, CASE WHEN lead(yr) OVER w = yr + 1 THEN n + lead(n) OVER w END AS pair FROM y WINDOW w AS (PARTITION BY place, tag ORDER BY yr)),
g AS (SELECT place, tag, sum(n) AS n, count(*) AS years, greatest(max(n), coalesce(max(pair), 0)) AS peak FROM pr GROUP BY ALL),
k AS (SELECT place, tag, n, 100 * n / total AS pct, (n / total) / (freq / c) AS score, years, n >= 5 AND peak / n > 0.4 AS is_event
  FROM g JOIN t USING (place) JOIN base USING (tag), corpus WHERE n >= 5 AND 100 * n / total >= 0.5),
f AS (SELECT *, row_number() OVER (PARTITION BY place, is_event ORDER BY score DESC, tag) AS rank FROM k WHERE is_event OR years >= 2)
SELECT place, tag, CAST(n AS BIGINT) AS n, round(pct, 6) AS pct, round(score, 6) AS score, years, is_event, CAST(rank AS INT) AS rank FROM f WHERE rank <= CASE WHEN is_event THEN 6 ELSE 8 END""")
def theme_query_scored(spark, sf):
    """The theme query for every place at once, with a burst limit that the tables reach."""
    from archivolt.operators.themes import corpus_baseline, place_tags, themes

    rows, tags = articles(spark, sf), article_subject(spark, sf)
    out = themes(place_tags(rows, tags), rows, *corpus_baseline(rows, tags), burst=0.4)
    return out.select("place", F.col("subject").alias("tag"), "n", F.round("pct", 6).alias("pct"), F.round("score", 6).alias("score"), "years", "is_event", "rank")


@query("""WITH c AS (SELECT l_suppkey AS k, count(*) AS n, l_suppkey // 3 AS g, l_suppkey % 3 AS form FROM lineitem GROUP BY l_suppkey),
m AS (SELECT *, 'Ann ' || CASE form WHEN 0 THEN '' WHEN 1 THEN 'E. ' ELSE 'Ellen ' END || 'Smith' || g AS name FROM c),
b AS (SELECT g, arg_min(name, (-n, name)) AS best FROM m WHERE form > 0 GROUP BY g)
SELECT name, CASE WHEN form = 0 THEN name ELSE best END AS canonical FROM m LEFT JOIN b USING (g)""")
def name_variant_merge(spark, sf):
    """Supplier names of three words with a middle part cut short for some, counted by their line items. A name without a
    middle part has too many records here to go under another, so the initial and the full name meet alone."""
    counts = read(spark, sf, "lineitem", "l_suppkey").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    k = F.col("l_suppkey")
    middle = F.when(k % 3 == 0, "").when(k % 3 == 1, "E. ").otherwise("Ellen ")
    name = F.concat(F.lit("Ann "), middle, F.lit("Smith"), (F.floor(k / 3)).cast("string"))
    return J.name_variants(counts.select(name.alias("name"), "n"))


@query("""WITH c AS (SELECT c_custkey AS k, 'Last' || (c_custkey // 2) || ', First' || CASE WHEN c_custkey % 2 = 1 THEN ' M.' ELSE '' END AS name,
  CASE WHEN c_custkey % 2 = 1 THEN 40 + c_custkey ELSE c_custkey % 5 + 1 END AS n FROM customer)
SELECT a.name, b.name AS "into" FROM c a JOIN c b ON a.k // 2 = b.k // 2 AND a.k % 2 = 0 AND b.k % 2 = 1 WHERE a.n <= 50 AND b.n >= 15 * a.n""")
def person_prefix_merge(spark, sf):
    rows = read(spark, sf, "customer", "c_custkey")
    k = F.col("c_custkey")
    name = F.concat(F.lit("Last"), (F.floor(k / 2)).cast("string"), F.lit(", First"), F.when(k % 2 == 1, " M.").otherwise(""))
    return J.person_prefixes(rows.select(name.alias("name"), F.when(k % 2 == 1, 40 + k).otherwise(k % 5 + 1).alias("n"), k.alias("seq")))


@query(sql("headline", """,
p AS (SELECT 'red widget' AS a, 'Red Things' AS b UNION ALL SELECT 'small ring', 'tiny ring' UNION ALL SELECT 'tiny ring', 'Ring')
SELECT article_id, coalesce(z.b, y.b, x.b, headline) AS headline FROM headline LEFT JOIN p x ON headline = x.a LEFT JOIN p y ON x.b = y.a LEFT JOIN p z ON y.b = z.a"""))
def override_chain(spark, sf):
    """Overrides followed up to three hops, as one lookup of their closure."""
    pairs = spark.createDataFrame([("red widget", "Red Things"), ("small ring", "tiny ring"), ("tiny ring", "Ring")], "headline string, fixed string")
    rows = headlines(spark, sf).join(J.closure(pairs, "headline", "fixed"), "headline", "left")
    return rows.select("article_id", F.coalesce("fixed", "headline").alias("headline"))
