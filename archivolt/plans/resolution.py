"""Queries of resolution, marts by period, normalised records, flags and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from archivolt.functions import dates as D
from archivolt.functions import names as N
from archivolt.functions import text as X
from archivolt.operators import classify as C
from archivolt.operators import marts as M
from archivolt.operators import matching as J
from archivolt.operators import quality as Q
from archivolt.operators import themes as T
from archivolt.plans.aggregates import _CREDITS, _MART, _credits
from archivolt.plans.views import article_author, article_subject, articles, headlines, read, records, sql
from archivolt.sources import archive as A
from archivolt.sources.shared import new_folder

QUERIES, ORACLES = {}, {}


def query(text: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, text
        return f

    return add


def _pick(key, *values):
    """The value that the key's remainder picks; None for null."""
    return F.element_at(F.array(*(v if hasattr(v, "_jc") else F.lit(v) for v in values)), (key % len(values) + 1).cast("int"))


@query(sql("author record", _CREDITS + """
SELECT author, yr, count(*) AS n, count(*) FILTER (n_authors > 1) AS n_shared, CAST(sum(word_count // n_authors) AS BIGINT) AS words,
  count(*) FILTER (section = '1-URGENT') AS n_urgent, CAST(coalesce(sum(word_count // n_authors) FILTER (section = '1-URGENT'), 0) AS BIGINT) AS words_urgent,
  count(*) FILTER (material = 'P') AS n_brief, CAST(coalesce(sum(word_count // n_authors) FILTER (material = 'P'), 0) AS BIGINT) AS words_brief
FROM credits GROUP BY author, yr"""))
def author_year_mart(spark, sf):
    flags = {"urgent": F.col("section") == "1-URGENT", "brief": F.col("material") == "P"}
    return M.author_periods(_credits(spark, sf), "yr", flags)


@query(sql("author record", _CREDITS + """,
y AS (SELECT author, section, yr, count(*) AS n FROM credits GROUP BY ALL), w AS (SELECT author, section, CAST(sum(n) AS BIGINT) AS n FROM y GROUP BY ALL),
l AS (SELECT author, section FROM (SELECT *, row_number() OVER (PARTITION BY author, yr ORDER BY n DESC, section) AS rn FROM y) WHERE rn = 1
  UNION SELECT author, section FROM (SELECT *, row_number() OVER (PARTITION BY author ORDER BY n DESC, section) AS rn FROM w) WHERE rn = 1)
SELECT * FROM (SELECT author, section, n, CAST(row_number() OVER (PARTITION BY author ORDER BY n DESC, section) AS INT) AS rank FROM w JOIN l USING (author, section)) WHERE rank <= 3"""))
def author_section_modes(spark, sf):
    return M.yearly_modes(_credits(spark, sf), "author", "yr", "section", 3)


@query(sql("author record", _CREDITS + _MART + """
SELECT * FROM mart WHERE author <> (SELECT min(author) FROM mart) UNION ALL
SELECT author, sum(1), CAST(sum(2 * word_count // n_authors) AS BIGINT), count(*) FILTER (word_count = 0), count(*) FILTER (material = 'P'),
  CAST(coalesce(sum(2 * word_count // n_authors) FILTER (material = 'P'), 0) AS BIGINT), count(*) FILTER (n_authors > 1), count(*) FILTER (n_authors = 1 AND 2 * word_count > 200),
  min(pub_date), max(pub_date), count(DISTINCT yr), CAST(round_even((sum(2 * word_count // n_authors) - coalesce(sum(2 * word_count // n_authors) FILTER (material = 'P'), 0))
    / (count(*) - count(*) FILTER (word_count = 0) - count(*) FILTER (material = 'P')), 0) AS BIGINT)
FROM credits WHERE author = (SELECT min(author) FROM mart) GROUP BY author"""))
def author_reaggregated(spark, sf):
    """The mart with the first author's row made anew from records whose words have doubled."""
    credits = _credits(spark, sf)
    name = credits.agg(F.min("author")).first()[0]
    changed = credits.withColumn("word_count", F.col("word_count") * 2)
    return M.reaggregated(M.author_mart(credits, brief="P"), changed, name, brief="P")


@query(sql("author article", """,
d AS (SELECT place, yr, count(DISTINCT author) AS n_distinct FROM article JOIN author USING (article_id) GROUP BY ALL)
SELECT * FROM d WHERE place IN (SELECT place FROM d GROUP BY place HAVING count(*) >= 3 AND max(n_distinct) >= 8)"""))
def reporters_by_place(spark, sf):
    rows = articles(spark, sf).select("article_id", "place", "yr").join(article_author(spark, sf), "article_id")
    return M.distinct_trends(rows, "place", "yr", "author", 3, 8)


@query(sql("article", """,
m AS (SELECT DISTINCT place FROM article WHERE section = '1-URGENT' AND place NOT IN ('NATION_1', 'NATION_4', 'NATION_20'))
SELECT place, false AS filled FROM m UNION ALL
SELECT * FROM (SELECT place, true FROM article WHERE section = '2-HIGH' INTERSECT SELECT n_name, true FROM nation WHERE n_nationkey < 8) WHERE place NOT IN (SELECT place FROM m)"""))
def places_filled(spark, sf):
    """The places of one section, with those of a special list that only another section covers."""
    rows = articles(spark, sf).select("section", "place")
    main = rows.where("section = '1-URGENT' AND place NOT IN ('NATION_1', 'NATION_4', 'NATION_20')")
    special = read(spark, sf, "nation", "n_nationkey", "n_name").where("n_nationkey < 8").select(F.col("n_name").alias("place"))
    return M.filled_from(main, rows.where("section = '2-HIGH'"), "place", special)


@query(sql("author record", """,
k AS (SELECT article_id, string_agg(author, '|' ORDER BY author) AS authors FROM author GROUP BY 1),
r AS (SELECT DISTINCT section, authors FROM k JOIN record USING (article_id)), a AS (SELECT unnest(string_split(authors, '|')) AS author FROM r)
SELECT author, count(*) AS n FROM a GROUP BY author ORDER BY n DESC, author LIMIT 50"""))
def corrections_top_authors(spark, sf):
    """Counts by author after duplicates are rolled up, not before."""
    names = article_author(spark, sf).groupBy("article_id").agg(F.sort_array(F.collect_list("author")).alias("authors"))
    rows = names.join(records(spark, sf), "article_id")
    rolled = J.roll_up(rows, ["section", "authors"], ["pub_date", "article_id"], ["article_id"], "article_id")
    return M.top_counts(rolled.select(F.explode("authors").alias("author")), "author", 50)


_PLACES = ("Newark (NJ)", "ARIZONA", "Queens", "Virgin Islands (US)", "Albany (N.Y.)", "washington (state)", "TOPEKA (KAN)", "Paris (France)", "District of Columbia", None)
_STATES = ("New Jersey", "Arizona", "New York", "U.S. Virgin Islands", "New York", "Washington", "Kansas", None, "D.C.", None)


def _case(key: str, values) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {'NULL' if v is None else repr(v)}" for i, v in enumerate(values)) + " END"


@query(f"""SELECT c_custkey, {_case('c_custkey', _STATES)} AS state, coalesce({_case('c_custkey', _STATES)} = 'U.S. Virgin Islands', false) AS territory FROM customer""")
def state_resolver(spark, sf):
    """States and territories of places that the customer's key picks."""
    state = X.state_of(_pick(F.col("c_custkey"), *_PLACES))
    return read(spark, sf, "customer", "c_custkey").select("c_custkey", state.alias("state"), F.coalesce(X.is_territory(state), F.lit(False)).alias("territory"))


@query("""WITH c AS (SELECT c_custkey, n_name AS n, c_custkey % 5 AS k FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey, CASE k WHEN 0 THEN 'Great ' || n WHEN 1 THEN 'Joined ' || n WHEN 2 THEN 'Nation ' || replace(n, 'NATION_', '') WHEN 3 THEN NULL ELSE n END AS country FROM c""")
def country_resolver(spark, sf):
    """Countries: by an exact table, by the last parentheses, by title case, dropped, or as they are."""
    place = F.col("n_name")
    number = F.replace(place, F.lit("NATION_"), F.lit(""))
    k = F.col("c_custkey")
    given = _pick(k, F.concat(F.lit("Old "), place), F.concat(F.lit("Town (Shire) ("), place, F.lit(")")), F.concat(F.lit("NATION "), number), F.lit("Nowhere"), F.concat(F.lit("Port ("), place, F.lit(")")))
    names = [r.n_name for r in read(spark, sf, "nation", "n_name").collect()]  # a table of 25 rows
    exact = {f"Old {n}": f"Great {n}" for n in names}
    parents = {n: f"Joined {n}" for n in names}
    rows = read(spark, sf, "customer", "c_custkey", "c_nationkey").join(read(spark, sf, "nation", "n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    country = F.when(k % 5 == 4, X.country_of(given, exact, {}, ["Nowhere"])).otherwise(X.country_of(given, exact, parents, ["Nowhere"]))
    return rows.select("c_custkey", country.alias("country"))


@query("""SELECT o_orderkey AS id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS pub_date, CAST(year(o_orderdate) AS INT) AS yr, strftime(o_orderdate, '%Y-%m') AS year_month,
  CASE WHEN o_orderkey % 9 = 0 THEN '' WHEN o_orderkey % 3 = 0 THEN 'print ' || o_orderstatus ELSE 'main ' || o_orderstatus END AS headline,
  CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE CAST(floor(o_totalprice) AS INT) END AS word_count,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'Urgent' ELSE o_orderpriority END AS section, o_orderkey % 2 = 0 AS front_page,
  o_orderstatus || ',common' AS subjects, CASE WHEN o_orderkey % 2 = 0 THEN 'Roe, Jane' ELSE '' END AS persons
FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0""")
def normalised_records(spark, sf):
    """Nested records made of orders, flattened by the library: other spellings, missing parts, and records that don't count."""
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    rows = read(spark, sf, "orders", "o_orderkey", "o_orderdate", "o_orderstatus", "o_totalprice", "o_orderpriority")
    word = lambda kind, value: F.struct(F.lit(kind).alias("name"), value.alias("value"))
    keywords = F.array(
        word("Subject", status), word("subject", F.lit("common")), word("SUBJECT", status), word("subject", F.lit("")),
        F.when(k % 2 == 0, word("Person", F.lit("Roe, Jane"))).otherwise(word("glocations", F.lit("x"))),
    )
    text = lambda c: F.lit(c).cast("string")
    none = F.lit(None).cast("string")
    raw = rows.select(
        F.when(k % 7 == 0, F.lit("0001-01-01")).otherwise(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T23:59:00-0500"))).alias("pub_date"),
        F.struct(F.when(k % 3 != 0, F.concat(F.lit("main "), status)).alias("main"), F.when(k % 9 != 0, F.concat(F.lit("print "), status)).alias("print_headline"), none.alias("kicker")).alias("headline"),
        F.struct(none.alias("original"), F.lit(None).cast("array<struct<firstname:string,middlename:string,lastname:string>>").alias("person")).alias("byline"),
        F.when(k % 4 == 0, "many").otherwise(F.floor("o_totalprice").cast("string")).alias("word_count"),
        F.when(k % 11 == 0, "Archives").otherwise(F.col("o_orderpriority")).alias("section_name"), none.alias("subsection_name"), none.alias("news_desk"),
        none.alias("document_type"), F.when(k % 13 == 0, "Paid Death Notice").alias("type_of_material"), F.concat(F.lit("https://x/"), k.cast("string")).alias("web_url"),
        text("A").alias("print_section"), F.when(k % 2 == 0, "1").otherwise("2").alias("print_page"), keywords.alias("keywords"), none.alias("abstract"),
        none.alias("snippet"), none.alias("lead_paragraph"),
    )
    out = A.normalise(raw, {"1-URGENT": "Urgent"})
    return out.select(
        F.substring_index("url", "/", -1).cast("long").alias("id"), F.col("pub_date").cast("string").alias("pub_date"), "yr", "year_month", "headline", "word_count",
        "section", "front_page", F.array_join("subjects", ",").alias("subjects"), F.array_join("persons", ",").alias("persons"),
    )


@query("""SELECT page_id FROM pages WHERE page_id % 6 = 0 OR (page_id % 6 = 1 AND page_id % 5 = 0) OR page_id % 6 = 4""")
def obituary_gate(spark, sf):
    """Admission of obituaries: six kinds of records by the page's id."""
    k = F.col("page_id")
    rows = read(spark, sf, "pages", "page_id").select(
        k, _pick(k, "Jane Roe, Painter, Dies at 80", "Jane Roe, Painter", "Jane Roe Dies", "Deaths Last Week: Some Died", "A Profile", "Jane Roe Dies").alias("headline"),
        _pick(k, "Arts", "Obituaries", "Arts", "Obituaries", "", "Obituaries").alias("section"), _pick(k, "Obits", "", "", "", "National / Portraits of Grief", "").alias("desk"),
        _pick(k, "News", "News", "News", "News", None, "Video").alias("material"),
        F.when(k % 5 == 0, "https://x/a/jane-roe-dead.html").otherwise("https://x/a.html").alias("url"),
    )
    return C.obituaries(rows).select("page_id")


@query("""SELECT page_id, page_id % 4 = 0 OR page_id % 4 = 1 AND page_id % 3 = 0 AS quote, page_id % 5 = 0 AS recommendation, page_id % 6 = 0 OR page_id % 7 = 0 OR page_id % 8 = 0 AS correction,
  page_id % 9 = 0 OR page_id % 10 = 0 AS wedding, page_id % 10 = 0 AS vows, page_id % 2 = 0 AS real_reporter, page_id % 3 = 1 AS generic, page_id % 3 = 2 AS descriptive FROM pages""")
def record_flags(spark, sf):
    """Quotes of the day, recommendations, corrections, weddings, real reporters, generic tags and descriptive names."""
    k = F.col("page_id")
    quote = C.is_quote_of_day(F.when(k % 4 == 0, "Quote of the Day: x").otherwise("x"), F.when(k % 4 == 1, "Quote").otherwise("News"), F.when(k % 3 == 0, "Corrections").otherwise("News"))
    recommended = C.is_recommendation(F.lit("x"), F.when(k % 5 == 0, "Letter of Recommendation").otherwise(None))
    subjects = F.array(F.when(k % 6 == 0, "Correction Stories").otherwise("x"))
    correction = C.is_correction(subjects, F.when(k % 7 == 0, "Corrections").otherwise("News"), F.when(k % 8 == 0, "/2010/c-corrections-1").otherwise("/2010/a"))
    wedding = C.weddings(F.lit("https://x/a"), F.when(k % 9 == 0, "Weddings").otherwise(""), F.array(F.lit("x")), F.when(k % 10 == 0, "Her: Vows").otherwise("Mini-Vows"))
    reporter = X.is_real_reporter(_pick(k, "Jane Roe", F.when(k % 4 == 1, "The Wire").otherwise("Wire")), ["Wire"])
    return read(spark, sf, "pages", "page_id").select(
        k, quote.alias("quote"), recommended.alias("recommendation"), correction.alias("correction"), wedding["announcement"].alias("wedding"), wedding["vows"].alias("vows"),
        reporter.alias("real_reporter"), X.is_generic(_pick(k, "Arts", "Books and more", "Music"), [], ["Books"]).alias("generic"),
        X.is_descriptive(_pick(k, "Jane Roe", "Ann Poe", "Noted Painter"), ["painter"]).alias("descriptive"),
    )


@query("""SELECT page_id, 'it''s page ' || page_id AS headline, CASE WHEN page_id % 2 = 0 THEN 'Page ' || page_id ELSE 'Old page' END AS quoted,
  CAST(DATE '2020-01-01' + CAST(page_id % 300 AS INT) AS VARCHAR) AS in_path, CAST(DATE '2020-01-01' + CAST(page_id % 300 AS INT) AS VARCHAR) AS written,
  CASE page_id % 3 WHEN 0 THEN 'Big Board' WHEN 1 THEN 'IBM' ELSE 'ACME Corp' END AS entity,
  CASE page_id % 4 WHEN 0 THEN 'Jane Roe' WHEN 1 THEN 'Ann Poe' WHEN 2 THEN 'Al Day' ELSE 'Bo Fox' END AS person FROM pages""")
def text_keys(spark, sf):
    """Headline keys, quoted headlines, dates in paths and stamps, entities, and persons of obituaries' headlines."""
    k = F.col("page_id")
    text = k.cast("string")
    day = F.date_add(F.lit("2020-01-01").cast("date"), (k % 300).cast("int"))
    quoted = F.when(k % 2 == 0, F.concat(F.lit('An item "Page '), text, F.lit('" had'))).otherwise(F.lit("An item “Old page” had"))
    person = _pick(k, "Dr. Jane Roe (Jo to All), Painter, Dies at 80", "Jazz's Ann Poe Dies at 91; A Singer", "Killed at 71, Al Day Led a Life", "Overlooked No More: Bo Fox, Poet")
    return read(spark, sf, "pages", "page_id").select(
        k, X.headline_key(F.concat(F.lit("  “It’s  PAGE "), text, F.lit("”. "))).alias("headline"), X.quoted_headline(quoted).alias("quoted"),
        D.date_in_path(F.concat(F.lit("https://x/"), F.date_format(day, "yyyy/MM/dd"), F.lit("/a.html"))).cast("string").alias("in_path"),
        D.iso_day(F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T23:30:00-05:00"))).cast("string").alias("written"),
        X.normalise_entity(_pick(k, "big board", "IBM", "ACME Corp"), {"big board": "Big Board"}).alias("entity"), X.person_in_headline(person).alias("person"),
    )


@query("""WITH d AS (SELECT doc_id, CAST(doc_id % 10 AS INT) AS far, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda w: w <> '')) AS n FROM documents)
SELECT doc_id, CASE WHEN far >= 7 THEN 'far' WHEN n < 15 THEN 'short' ELSE 'long' END AS why FROM d WHERE far >= 7 OR n < 15 OR n > 200""")
def odd_match_audit(spark, sf):
    rows = read(spark, sf, "documents", "doc_id", "text").withColumn("far", (F.col("doc_id") % 10).cast("int"))
    return Q.odd_matches(rows, "far", "text").select("doc_id", "why")


@query("""SELECT page_id FROM pages WHERE page_id % 5 IN (1, 3, 4)""")
def odd_name_audit(spark, sf):
    """Names of five words, with a descriptive word, or with a role of twelve words."""
    k = F.col("page_id")
    rows = read(spark, sf, "pages", "page_id").select(
        k, _pick(k, "Jane Roe", "One Two Three Four Five", None, "Noted Painter", "Al Day").alias("name"),
        F.when(k % 5 == 4, " ".join(["word"] * 12)).otherwise("poet").alias("role"),
    )
    return Q.odd_names(rows, "name", "role", ["painter"]).select("page_id")


@query(sql("record", " SELECT yr, count(*) AS n FROM record GROUP BY yr"))
def checked_counts(spark, sf):
    """Counts of rows that are checked as they are read: a broken row would end the query."""
    checked = Q.expect(records(spark, sf), F.col("article_id") >= 0, "an id is negative")
    return checked.groupBy("yr").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'Great Britain' WHEN 1 THEN 'Czech Republic' WHEN 2 THEN 'Ivory Coast' ELSE n_name END AS place FROM nation""")
def place_alias_request(spark, sf):
    asked = _pick(F.col("n_nationkey"), "UK", "Czechia", "Côte d'Ivoire", F.col("n_name"))
    return read(spark, sf, "nation", "n_nationkey", "n_name").select("n_nationkey", T.canonical_place(asked).alias("place"))


@query("""SELECT n_nationkey, n_name FROM nation""")
def override_file(spark, sf):
    """A table of overrides as it comes from a spreadsheet: saved as CSV, with blanks and an empty row, and read again."""
    rows = read(spark, sf, "nation", "n_nationkey", "n_name").select(F.col("n_nationkey").cast("string").alias("n_nationkey"), F.concat(F.lit("  "), "n_name").alias("n_name"))
    path = f"{new_folder(spark, 'overrides')}.csv"
    empty = spark.createDataFrame([(None, None)], rows.schema)
    rows.unionByName(empty).write.option("header", True).option("ignoreLeadingWhiteSpace", False).csv(path)
    return A.read_overrides(spark, path, "n_nationkey BIGINT, n_name STRING")


@query("""SELECT * FROM (VALUES (1, true), (2, false), (3, true), (4, false)) t(step, written)""")
def written_once(spark, sf):
    """A mart is written once, not again for the same rows in another order, again when a row changes, and then once."""
    rows, path = read(spark, sf, "nation", "n_nationkey", "n_name"), f"{new_folder(spark, 'once')}"
    changed = rows.withColumn("n_name", F.when(F.col("n_nationkey") == 3, "Other").otherwise(F.col("n_name")))
    steps = (rows, rows.orderBy(F.desc("n_nationkey")), changed, changed)
    return spark.createDataFrame([(k, A.write_if_changed(df, path)) for k, df in enumerate(steps, 1)], "step int, written boolean")


@query("""WITH p AS (SELECT page_id, page_id % 30 AS day, lower(url) AS url FROM pages), r AS (SELECT c_custkey, c_custkey % 30 AS day, CASE WHEN c_custkey % 2 = 0 THEN 'Example' ELSE 'zzz' END AS word FROM customer)
SELECT r.c_custkey, coalesce(min(p.page_id), -1) AS hit FROM r LEFT JOIN p ON r.day = p.day AND (r.c_custkey = p.page_id OR contains(p.url, lower(r.word))) GROUP BY r.c_custkey
HAVING NOT bool_or(coalesce(r.c_custkey = p.page_id, false)) UNION ALL SELECT c_custkey, c_custkey FROM customer JOIN pages ON c_custkey = page_id""")
def fallback_contained(spark, sf):
    """The page of a customer's own number, else the first of its day whose address holds its word."""
    k = F.col("c_custkey")
    rows = read(spark, sf, "customer", "c_custkey").select(k, (k % 30).alias("day"), F.when(k % 2 == 0, "Example").otherwise("zzz").alias("word"))
    pages = read(spark, sf, "pages", "page_id", "url").select(F.col("page_id").alias("hit"), (F.col("page_id") % 30).alias("day"), "url")
    own = rows.join(pages, F.col("c_custkey") == F.col("hit")).select("c_custkey", "hit")
    held = J.contained_step(rows, pages, "day", "word", "url", "hit").select("c_custkey", "hit")
    return J.fallback_join(rows.select("c_custkey"), "c_custkey", [own, held], [F.asc("hit")]).select("c_custkey", F.coalesce("hit", F.lit(-1)).alias("hit"))


@query(sql("headline subject record", """,
s AS (SELECT article_id, string_agg(subject, ' ' ORDER BY subject) AS subjects FROM subject GROUP BY 1),
t AS (SELECT article_id, lower(headline || ' ' || subjects) AS x, lower(headline) AS title FROM headline JOIN s USING (article_id))
SELECT article_id, title, CAST(len(list_distinct(list_filter(string_split(x, ' '), lambda w: length(w) > 3))) AS INT) AS n_words FROM t"""))
def record_match_pool(spark, sf):
    """The words and titles of records, as the matching of corrections takes them."""
    subjects = article_subject(spark, sf).groupBy("article_id").agg(F.collect_list("subject").alias("subjects"))
    rows = headlines(spark, sf).join(subjects, "article_id").withColumn("url", F.lit("/-/"))
    pool = J.match_pool(rows.withColumn("day", F.lit("2024-01-01").cast("date")), "article_id", "day", "headline", "url", "subjects")
    return pool.select(F.col("partner").alias("article_id"), "title", F.size("words").alias("n_words"))


@query("""SELECT page_id, CAST(k AS INT) AS no, CASE k WHEN 0 THEN 'An article on Dec. 30 about page ' || page_id || ' misstated "The Title ' || page_id || '" in it.'
    ELSE 'Because of an editing error, a caption on page ' || page_id || ' was wrong & late.' END AS text,
  CASE WHEN k = 0 AND page_id % 2 = 0 THEN '/2024/01/02/x/' || page_id || '.html' END AS link, CASE k WHEN 0 THEN 'The Title ' || page_id END AS headline,
  CASE k WHEN 0 THEN '2023-12-30' ELSE '2024-01-05' END AS refers_to FROM pages, range(2) r(k) WHERE k = 0 OR page_id % 3 <> 0""")
def correction_page_items(spark, sf):
    """Corrections of pages made up by the page's id: links, quoted headlines, dates, footers and paragraphs that are none."""
    k = F.col("page_id")
    text = k.cast("string")
    link = F.when(k % 2 == 0, F.concat(F.lit('<a class="x" href="https://site/2024/01/02/x/'), text, F.lit('.html?a=1">it</a>'))).otherwise(F.lit("<a href='https://site/pageoneplus/c.html'>it</a>"))
    html = F.concat(
        F.lit("<script>var p='<p>An article here is a long enough paragraph</p>'</script><nav>x</nav><p>An article on Dec. 30 about page "), text,
        F.lit(" misstated &quot;The Title "), text, F.lit("&quot; in "), link, F.lit(".</p><p>Short.</p><p>A paragraph of enough length that is no correction at all</p>"),
        F.when(k % 3 != 0, F.concat(F.lit("<p class=c>Because of an editing error, a <b>caption</b> on page "), text, F.lit(" was wrong &amp; late.</p>"))).otherwise(""),
        F.lit("<p>An item: Errors are corrected during the press run whenever possible.</p>"),
    )
    day = F.lit("2024-01-05").cast("date")
    items = read(spark, sf, "pages", "page_id").select(k, F.posexplode(X.correction_items(html)).alias("no", "i")).select("page_id", "no", "i.*")
    return items.withColumn("refers_to", D.reference_date(F.col("text"), day).cast("string"))


@query("""SELECT p_partkey, p_name, p_size, CAST(0 AS INT) AS no FROM part WHERE p_partkey % 5 <> 0 UNION ALL
SELECT p_partkey, CASE k WHEN 0 THEN 'first ' ELSE 'second ' END || p_name, CASE k WHEN 0 THEN 1 ELSE p_size END, CAST(k AS INT) FROM part, range(2) r(k) WHERE p_partkey % 5 = 0""")
def split_table_join(spark, sf):
    """Records of two people, split by a table of their parts; the others stay."""
    rows = read(spark, sf, "part", "p_partkey", "p_name", "p_size")
    part = lambda word, size: F.struct(F.concat(F.lit(word), "p_name").alias("p_name"), size.alias("p_size"))
    splits = rows.where("p_partkey % 5 = 0").select("p_partkey", F.array(part("first ", F.lit(1).cast(rows.schema["p_size"].dataType)), part("second ", F.col("p_size"))).alias("parts"))
    return J.split_join(rows, splits, "p_partkey", "parts")


@query(sql("author", """, c AS (SELECT author, count(*) AS n FROM author GROUP BY 1), k AS (SELECT author FROM c WHERE n >= (SELECT median(n) FROM c)),
o AS (SELECT * FROM author WHERE author IN (SELECT author FROM k))
SELECT a.author, b.author AS other, count(*) AS n FROM o a JOIN o b ON a.article_id = b.article_id AND a.author <> b.author GROUP BY ALL"""))
def coauthors_exported(spark, sf):
    """Co-authors among the authors who have a page of their own: here those of at least the median number of records."""
    names = article_author(spark, sf)
    counts = names.groupBy("author").agg(F.count(F.lit(1)).alias("n"))
    half = counts.agg(F.median("n").alias("m"))
    return M.pair_counts(names, "article_id", "author", counts.crossJoin(half).where("n >= m"))


@query(sql("article", """ SELECT CASE place WHEN 'NATION_2' THEN 'NATION_1' WHEN 'NATION_3' THEN 'NATION_1' ELSE place END AS place, count(*) AS n
FROM article WHERE place NOT IN ('NATION_5', 'NATION_6') GROUP BY 1"""))
def places_cleaned(spark, sf):
    rows = T.clean_places(articles(spark, sf), "place", ["NATION_5", "NATION_6"], {"NATION_2": "NATION_1", "NATION_3": "NATION_1"})
    return rows.groupBy("place").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH c AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1) SELECT p_brand, n FROM c WHERE n <= (SELECT CAST(floor(avg(n)) AS BIGINT) FROM c)""")
def rare_keys(spark, sf):
    rows = read(spark, sf, "part", "p_brand")
    mean = rows.agg((F.count(F.lit(1)) / F.count_distinct("p_brand")).alias("m")).first().m
    return Q.rare(rows, "p_brand", int(mean))


@query("""SELECT c_mktsegment AS segment, count(*) AS n, count(*) FILTER (c_custkey % 4 < 2) AS n_found, count(*) FILTER (c_custkey % 4 < 2) / count(*) AS rate
FROM customer WHERE c_custkey % 4 < 3 GROUP BY 1""")
def byline_parse_rate(spark, sf):
    """The share of bylines that give a person: names, lists, wire reports; records without a byline don't count."""
    k = F.col("c_custkey")
    original = _pick(k, "By Ann Lee", "Ann Lee and Bo Day", "From Wire Reports", None)
    none = F.lit(None).cast("array<struct<firstname:string,middlename:string,lastname:string>>")
    rows = read(spark, sf, "customer", "c_custkey", "c_mktsegment").select(F.col("c_mktsegment").alias("segment"), original.alias("original"))
    people = rows.withColumn("n", F.size(N.byline_people("original", none)))
    return Q.filled_rate(people, "segment", F.col("original").isNotNull(), F.col("n") > 0)


@query(sql("record", " SELECT yr, section, count(*) AS n FROM record WHERE yr IN (1995, 1997) GROUP BY ALL"))
def year_folder_scan(spark, sf):
    """Two years of a table that is kept in a folder for each year."""
    path = new_folder(spark, "years")
    A.write_by_year(records(spark, sf).select("yr", "section", "article_id"), path)
    return A.read_years(spark, path, [1995, 1997]).groupBy(F.col("yr").cast("int").alias("yr"), "section").agg(F.count(F.lit(1)).alias("n"))
