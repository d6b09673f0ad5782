"""URL filters by a temporal list join. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from archivolt.llm.common import table

_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"
#: A path prefix outranks every domain; below that, more labels or segments outrank fewer.
_PATH_RANK = 1000


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _HOST, 1))


def list_keys(url: Column, max_segments: int | None = None) -> Column:
    """Array of {key, rank}: the host and its parent domains down to two labels (a host of one label is a key itself), and its
    prefixes of path segments, of at most `max_segments` (None: all)."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    domains = F.transform(
        F.when(host != "", F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.array_join(F.slice(labels, i, n - i + 1), ".").alias("key"), (n - i + 1).alias("rank")),
    )
    segments = F.filter(F.split(F.regexp_extract(url, _PATH, 1), "/"), lambda s: s != "")
    deep = F.size(segments) if max_segments is None else F.least(F.size(segments), F.lit(max_segments))
    paths = F.transform(
        F.when((deep >= 1) & (host != ""), F.sequence(F.lit(1), deep)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(
            F.concat_ws("/", host, F.array_join(F.slice(segments, 1, i), "/")).alias("key"), (i + _PATH_RANK).alias("rank")
        ),
    )
    return F.coalesce(F.concat(domains, paths), F.array().cast("array<struct<key:string,rank:int>>"))


def validity(entries: DataFrame) -> DataFrame:
    """Dated entries (key, listed, action) as intervals (key, since, until, action): each holds from its date until the
    key's next one, the last one for good. Of entries with one key and date the greatest action ("block" over "allow")
    counts. Entries without a key or date are void."""
    days = entries.where("key IS NOT NULL AND listed IS NOT NULL").groupBy("key", "listed").agg(F.max("action").alias("action"))
    return days.select(
        "key", F.col("listed").alias("since"), F.lead("listed").over(W.partitionBy("key").orderBy("listed")).alias("until"), "action"
    )


def filter_urls(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """`captures` with verdict ("block", "allow", or "none" where no entry holds), list_key and listed_since.

    Every capture is judged by the entries in force at its own time. Its keys (domains and path prefixes of any depth) meet the
    list's validity intervals in an as-of join on the key: of a key's intervals at most one holds at a time. The most
    specific key that has one decides. Captures of one URL at one time are judged once and the verdict is joined back,
    so every row stays; the joins are equi-joins that adaptive execution can split at a hot domain, and nothing is
    broadcast on trust. A null or malformed URL and a null time get "none". Columns named like the results are replaced.
    Repeated rows are judged alike. No captures give no rows; without entries every verdict is "none". A long URL has as many
    keys as it has labels and segments, which grow with the square of its length.
    """
    rows = captures.drop("verdict", "list_key", "listed_since")
    asked = rows.select(F.col(url_col).alias("__url"), F.col(time_col).alias("__at")).where("__url IS NOT NULL AND __at IS NOT NULL")
    keyed = asked.distinct().select("__url", "__at", F.explode(list_keys(F.col("__url"))).alias("k")).select("__url", "__at", "k.*")
    spans = validity(entries).withColumnRenamed("key", "list_key")
    holds = (F.col("key") == F.col("list_key")) & (F.col("since") <= F.col("__at"))
    holds &= F.col("until").isNull() | (F.col("__at") < F.col("until"))
    best = F.max_by(F.struct("action", "list_key", "since"), "rank")
    found = keyed.join(spans, holds).groupBy("__url", "__at").agg(best.alias("__best"))
    same = (F.col(url_col) == F.col("__url")) & (F.col(time_col) == F.col("__at"))
    return (
        rows.join(found, same, "left")
        .withColumns({
            "verdict": F.coalesce("__best.action", F.lit("none")),
            "list_key": F.col("__best.list_key"),
            "listed_since": F.col("__best.since"),
        })
        .drop("__url", "__at", "__best")
    )


def _number(text: Column, at: int, size: int) -> Column:
    return F.conv(F.substring(text, at, size), 16, 10).cast("int")


def sample_list(pages: DataFrame) -> DataFrame:
    """A dated list over the pages' own keys (the tables have none): by the key's MD5, six in sixteen keys are blocked
    on some day of 2024, allowed again some weeks later, and half of those blocked once more."""
    keys = pages.select(F.explode(list_keys(F.col("url"))).alias("k")).select("k.key").distinct()
    keys = keys.withColumn("m", F.md5("key")).where(_number(F.col("m"), 1, 1) < 6)
    first = _number(F.col("m"), 2, 4) % 366
    allowed = first + 20 + _number(F.col("m"), 6, 2)
    day = lambda n: F.date_add(F.to_date(F.lit("2024-01-01")), n)
    parts = [
        keys.select("key", day(first).alias("listed"), F.lit("block").alias("action")),
        keys.select("key", day(allowed).alias("listed"), F.lit("allow").alias("action")),
        keys.where(_number(F.col("m"), 8, 1) % 2 == 0).select("key", day(allowed + 30).alias("listed"), F.lit("block").alias("action")),
    ]
    return reduce(DataFrame.union, parts)


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    """Pages carry no time, so each was fetched on day page_id mod 366 of 2024."""
    pages = table(spark, sf_dir, "pages", "page_id", "url")
    fetched = F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("page_id") % 366).cast("int"))
    judged = filter_urls(pages.withColumn("fetched", fetched), sample_list(pages))
    return judged.withColumns({c: F.col(c).cast("string") for c in ("fetched", "listed_since")})


OP3_SQL = r"""
WITH caps AS (
  SELECT page_id, url, CAST(DATE '2024-01-01' + CAST(page_id % 366 AS INT) AS DATE) AS fetched,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)) AS host,
         list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/'), lambda s: s <> '') AS segs
  FROM pages),
parts AS (SELECT *, string_split(host, '.') AS labels FROM caps),
keyed AS (
  SELECT page_id, fetched, array_to_string(labels[i:], '.') AS key, len(labels) - i + 1 AS rank
  FROM (SELECT *, unnest(range(1, greatest(len(labels), 2))) AS i FROM parts WHERE host <> '')
  UNION ALL
  SELECT page_id, fetched, host || '/' || array_to_string(segs[:i], '/'), 1000 + i
  FROM (SELECT *, unnest(range(1, len(segs) + 1)) AS i FROM parts WHERE host <> '')),
m AS (SELECT key, md5(key) AS m FROM (SELECT DISTINCT key FROM keyed)),
n AS (
  SELECT key, CAST('0x' || m[1:1] AS INT) AS pick, CAST('0x' || m[2:5] AS INT) % 366 AS first,
         20 + CAST('0x' || m[6:7] AS INT) AS later, CAST('0x' || m[8:8] AS INT) % 2 AS odd FROM m),
entries AS (
  SELECT key, CAST(DATE '2024-01-01' + first AS DATE) AS listed, 'block' AS action FROM n WHERE pick < 6
  UNION ALL SELECT key, CAST(DATE '2024-01-01' + (first + later) AS DATE), 'allow' FROM n WHERE pick < 6
  UNION ALL SELECT key, CAST(DATE '2024-01-01' + (first + later + 30) AS DATE), 'block' FROM n WHERE pick < 6 AND odd = 0),
spans AS (SELECT key, listed AS since, lead(listed) OVER (PARTITION BY key ORDER BY listed) AS until, action FROM entries),
hits AS (
  SELECT k.page_id, s.action, s.key, s.since, row_number() OVER (PARTITION BY k.page_id ORDER BY k.rank DESC) AS rn
  FROM keyed k JOIN spans s ON k.key = s.key AND s.since <= k.fetched AND (s.until IS NULL OR k.fetched < s.until))
SELECT c.page_id, c.url, CAST(c.fetched AS VARCHAR) AS fetched, coalesce(h.action, 'none') AS verdict, h.key AS list_key,
       CAST(h.since AS VARCHAR) AS listed_since
FROM caps c LEFT JOIN hits h ON c.page_id = h.page_id AND h.rn = 1
"""
