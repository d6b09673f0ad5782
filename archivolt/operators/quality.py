"""Checks of built tables. Each gives the rows that need a look; none stops a build but `expect`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivolt.functions.dates import age_class
from archivolt.functions.text import word_count


def zero_rate(df: DataFrame, key: str, value: str, least: int = 50, rate: float = 0.2) -> DataFrame:
    """Keys of at least `least` rows of which over `rate` have no value."""
    out = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(value, F.lit(0)) == 0).alias("n_zero"))
    return out.withColumn("rate", F.col("n_zero") / F.col("n")).where((F.col("n") >= least) & (F.col("rate") > rate))


def rare(df: DataFrame, key: str, most: int) -> DataFrame:
    """Keys of at most `most` rows, which may be misspelt."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= most)


def filled_rate(df: DataFrame, by: str, given: Column, found: Column) -> DataFrame:
    """By group: the rows where `given` holds, and the share of them where `found` holds too (bylines that gave a person,
    records that have a headline)."""
    out = df.where(given).groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(found).alias("n_found"))
    return out.withColumn("rate", F.col("n_found") / F.col("n"))


def unmapped(df: DataFrame, key: str, known: DataFrame, k: int = 20) -> DataFrame:
    """The k most frequent values that a mapping lacks."""
    lacking = df.join(known.select(key), key, "left_anti").groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return lacking.orderBy(F.desc("n"), key).limit(k)


def yield_drop(df: DataFrame, period: str, page: str, drop: float = 0.3, least: int = 50) -> DataFrame:
    """Periods whose items per page fell by over `drop` from the period before, both of at least `least` items."""
    own = df.groupBy(period).agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) / F.count_distinct(page)).alias("ratio"))
    before = own.select((F.col(period) + 1).alias(period), F.col("n").alias("n_before"), F.col("ratio").alias("ratio_before"))
    both = own.join(before, period).where((F.col("n") >= least) & (F.col("n_before") >= least))
    return both.where(F.col("ratio") < (1 - drop) * F.col("ratio_before")).select(period, "ratio_before", "ratio")


def gaps(needed: DataFrame, present: DataFrame, key: str, day: str, as_of: Column) -> DataFrame:
    """What is needed but not present, by month and age."""
    missing = needed.join(present.select(key), key, "left_anti")
    return missing.groupBy(F.date_format(day, "yyyy-MM").alias("month"), age_class(F.col(day), as_of).alias("age")).agg(F.count(F.lit(1)).alias("n"))


def odd_matches(df: DataFrame, distance: str, text: str, days: int = 7, words: tuple[int, int] = (15, 200)) -> DataFrame:
    """Matches that are far away in time, or whose text is very short or long."""
    n = word_count(text)
    why = F.when(F.col(distance) >= days, "far").when(n < words[0], "short").when(n > words[1], "long")
    return df.withColumn("why", why).where("why IS NOT NULL")


def odd_names(df: DataFrame, name: str, role: str, words: list[str]) -> DataFrame:
    """Parsed names of five or more words or with a descriptive word, and roles of twelve or more."""
    from archivolt.functions.text import is_descriptive

    bad = (word_count(name) >= 5) | (word_count(role) >= 12) | is_descriptive(F.col(name), words)
    return df.where(F.coalesce(bad, F.lit(False)))


def expect(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """`df`, which fails on the first row that breaks the condition; checked in the scan, without a pass of its own."""
    broken = F.when(~F.coalesce(condition, F.lit(False)), F.raise_error(F.lit(message)).cast("boolean"))
    return df.where(F.coalesce(broken, F.lit(True)))
