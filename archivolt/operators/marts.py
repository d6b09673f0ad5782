"""Aggregations over records: trends, medians, histograms, contributor and subject marts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def half_even(x: Column, digits: int = 0) -> Column:
    """Rounding of ties to even, as a long where no digits are kept."""
    out = F.bround(x, digits)
    return out.cast("long") if digits == 0 else out


def median(words: Column) -> Column:
    """Exact median of the positive values (a double; the mean of the middle two)."""
    return F.percentile(F.when(words > 0, words), 0.5)


def year_spine(df: DataFrame, key: str, year: str) -> DataFrame:
    """Every key with every year from the first to the last of the table. The right side of the join is one row."""
    bounds = df.agg(F.min(year).alias("__a"), F.max(year).alias("__b"))
    return df.select(key).distinct().crossJoin(bounds).select(key, F.explode(F.sequence("__a", "__b")).alias(year))


def trend(df: DataFrame, key: str, year: str, words: str) -> DataFrame:
    """Per key and year, dense over all years: count, half-even average over all records, half-even median over those
    with words."""
    w = F.col(words)
    found = df.groupBy(key, year).agg(
        F.count(F.lit(1)).alias("n"),
        half_even(F.sum(w) / F.count(F.lit(1))).alias("avg_words"),
        half_even(median(w)).alias("median_words"),
    )
    return year_spine(df, key, year).join(found, [key, year], "left").na.fill(0, ["n", "avg_words", "median_words"])


def bucketed(df: DataFrame, by: list[str], words: str, buckets: dict[str, Column], rest: str) -> DataFrame:
    """Counts and words of mutually exclusive buckets: a record is in the first whose condition holds, else in `rest`."""
    kind = F.lit(rest)
    for name, condition in reversed(buckets.items()):
        kind = F.when(condition, name).otherwise(kind)
    w = F.col(words).cast("long")
    sums = [F.count(F.lit(1)).alias("n"), F.sum(w).alias("words")]
    for name in (*buckets, rest):
        inside = F.col("__kind") == name
        sums += [F.count_if(inside).alias(f"n_{name}"), F.sum(F.when(inside, w).otherwise(0)).alias(f"words_{name}")]
    return df.withColumn("__kind", kind).groupBy(*by).agg(*sums)


def histogram(df: DataFrame, by: list[str], words: str, width: int = 200, last: int = 20) -> DataFrame:
    """Records with words by bin of `width`; the last bin takes all above."""
    bin_ = F.least(F.floor(F.col(words) / width), F.lit(last)).cast("int")
    return df.where(F.col(words) > 0).groupBy(*by, bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def shares(df: DataFrame, key: str, words: str) -> DataFrame:
    """Per key: count, words, half-even average over records with words, percent of all records to two places."""
    w = F.col(words)
    found = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.sum(w.cast("long")).alias("words"), F.count_if(w > 0).alias("n_words")
    )
    total = found.agg(F.sum("n").alias("__all"))
    return found.crossJoin(total).select(
        key, "n", "words",
        F.when(F.col("n_words") > 0, half_even(F.col("words") / F.col("n_words"))).otherwise(0).alias("avg_words"),
        F.bround(100 * F.col("n") / F.col("__all"), 2).alias("share"),
    )


def ranked(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group; `order` must be total. Spark limits each partition's groups before the shuffle."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def author_mart(credits: DataFrame, author: str = "author", brief: str = "B") -> DataFrame:
    """One pass over (author, article) rows that carry the article's columns and n_authors. Words are divided among the
    article's authors by floor division; the average leaves out wordless and brief records, each subtracted on its own."""
    share = F.floor(F.col("word_count") / F.greatest(F.col("n_authors"), F.lit(1))).cast("long")
    brief_ = F.col("material") == brief
    out = credits.groupBy(author).agg(
        F.count(F.lit(1)).alias("n_articles"),
        F.sum(share).alias("words"),
        F.count_if(F.col("word_count") == 0).alias("n_zero"),
        F.count_if(brief_).alias("n_brief"),
        F.sum(F.when(brief_, share).otherwise(0)).alias("words_brief"),
        F.count_if(F.col("n_authors") > 1).alias("n_shared"),
        F.count_if((F.col("n_authors") == 1) & (F.col("word_count") > 200)).alias("n_solo"),
        F.min("pub_date").alias("first_date"),
        F.max("pub_date").alias("last_date"),
        F.count_distinct("yr").alias("n_years"),
    )
    rest = F.col("n_articles") - F.col("n_zero") - F.col("n_brief")
    average = F.when(rest != 0, half_even((F.col("words") - F.col("words_brief")) / rest)).otherwise(0)
    return out.withColumn("avg_words", average)


def primary_secondary(df: DataFrame, key: str, category: str) -> DataFrame:
    """The most frequent and the second category of each key; ties by name."""
    counts = df.groupBy(key, category).agg(F.count(F.lit(1)).alias("n"))
    top = ranked(counts, [key], [F.desc("n"), F.asc(category)], 2)
    pick = lambda r: F.max(F.when(F.col("rank") == r, F.col(category)))
    return top.groupBy(key).agg(pick(1).alias("primary"), pick(2).alias("secondary"))


def annualised(df: DataFrame, key: str, date: str, words: str) -> DataFrame:
    """Words by key and year, with edge years scaled to 365 days: a lone year by its span, a first year by the days left
    from the first record, a last year by the days up to the last one; inner years stay."""
    by_year = df.groupBy(key, F.year(date).alias("yr")).agg(
        F.sum(F.col(words).cast("long")).alias("words"), F.min(date).alias("__a"), F.max(date).alias("__b")
    )
    w = W.partitionBy(key)
    first, last = F.min("__a").over(w), F.max("__b").over(w)
    a, b, y = F.col("first"), F.col("last"), F.col("yr")
    days = (
        F.when(F.year(a) == F.year(b), F.date_diff(b, a) + 1)
        .when(y == F.year(a), F.date_diff(F.make_date(y, F.lit(12), F.lit(31)), a) + 1)
        .when(y == F.year(b), F.date_diff(b, F.make_date(y, F.lit(1), F.lit(1))) + 1)
    )
    out = by_year.select(key, "yr", "words", first.alias("first"), last.alias("last")).withColumn("days", days)
    scaled = F.when(F.col("days").isNull(), F.col("words")).otherwise(half_even(F.col("words") * 365 / F.col("days")))
    return out.select(key, "yr", "words", scaled.cast("long").alias("words_annual"))


def tenure_rate(df: DataFrame, key: str, date: str, words: str, least_days: int = 90) -> DataFrame:
    """Words a year over the span of dates; 0 for spans under `least_days`."""
    out = df.groupBy(key).agg(F.sum(F.col(words).cast("long")).alias("words"), F.date_diff(F.max(date), F.min(date)).alias("__d"))
    rate = F.when(F.col("__d") >= least_days, half_even(F.col("words") / (F.col("__d") / 365.25))).otherwise(0)
    return out.select(key, "words", rate.alias("words_per_year"))


def likely_multimedia(
    mart: DataFrame, zero: float = 0.35, few_words: int = 100, audio: tuple[str, ...] = ("Podcasts",),
    structural: tuple[str, ...] = ("Crosswords & Games", "Briefing"),
) -> DataFrame:
    """author_mart rows with `primary` joined: five routes by ratios, unless 20 solo texts show a reporter."""
    n = F.col("n_articles")
    shared, wordless, some = F.col("n_shared") / n, F.col("n_zero") / n, n >= 5
    routes = (
        (some & (shared >= 0.75) & (wordless >= zero))
        | ((n >= 20) & (wordless >= 0.95))
        | (some & (shared >= 0.9) & (F.col("avg_words") < few_words))
        | (some & F.col("primary").isin(*audio))
        | (some & (shared >= 0.9) & F.col("primary").isin(*structural))
    )
    return mart.withColumn("likely_multimedia", F.coalesce(routes & (F.col("n_solo") < 20), F.lit(False)))


def author_periods(credits: DataFrame, period: str, flags: dict[str, Column], author: str = "author") -> DataFrame:
    """Per author and period (a year or a month): records, shared ones, words (divided as in `author_mart`), and for each
    flag (blogs, live pages, podcasts) its records and their words."""
    share = F.floor(F.col("word_count") / F.greatest(F.col("n_authors"), F.lit(1))).cast("long")
    kinds = [c for name, flag in flags.items() for c in (F.count_if(flag).alias(f"n_{name}"), F.sum(F.when(flag, share).otherwise(0)).alias(f"words_{name}"))]
    return credits.groupBy(author, period).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_authors") > 1).alias("n_shared"), F.sum(share).alias("words"), *kinds
    )


def yearly_modes(df: DataFrame, key: str, year: str, category: str, k: int = 6) -> DataFrame:
    """(key, category, n, rank): the categories that lead some year of the key, or all of its years together; up to `k` of
    them by all their records. Ties by name."""
    by_year = df.groupBy(key, category, year).agg(F.count(F.lit(1)).alias("n"))
    leads = ranked(by_year, [key, year], [F.desc("n"), F.asc(category)], 1).select(key, category)
    whole = by_year.groupBy(key, category).agg(F.sum("n").alias("n"))
    first = ranked(whole, [key], [F.desc("n"), F.asc(category)], 1).select(key, category)
    return ranked(whole.join(leads.union(first).distinct(), [key, category]), [key], [F.desc("n"), F.asc(category)], k)


def reaggregated(mart: DataFrame, credits: DataFrame, name: str, author: str = "author", **how) -> DataFrame:
    """An `author_mart` in which one author's row is made anew from the credits, as after a change of bylines."""
    own = author_mart(credits.where(F.col(author) == name), author, **how)
    return mart.where(F.col(author) != name).unionByName(own.select(mart.columns))


def pair_counts(df: DataFrame, group: str, item: str, only: DataFrame | None = None) -> DataFrame:
    """Ordered pairs of different items within a group and the number of groups they share. The pairs of a group are
    made by two explodes of its own small array (contributors or tags of one record), so no join shuffles the groups.
    only: (item), the items that count, as the authors who have a page."""
    df = df.join(only.select(item).distinct(), item, "left_semi") if only is not None else df
    sets = df.groupBy(group).agg(F.collect_set(item).alias("__s"))
    pairs = sets.select("__s", F.explode("__s").alias(item)).select(item, F.explode("__s").alias("other"))
    return pairs.where(F.col(item) != F.col("other")).groupBy(item, "other").agg(F.count(F.lit(1)).alias("n"))


def lift(df: DataFrame, key: str, subject: str, corpus: DataFrame, n_docs: DataFrame, least_lift: float = 2.0, k: int = 7) -> DataFrame:
    """The k most frequent subjects of each key whose share there is at least `least_lift` times that of the corpus and
    whose count is at least max(2, 3 %). df: (key, article, subject); corpus: (subject, corpus_n); n_docs: one row."""
    own = df.groupBy(key, subject).agg(F.count(F.lit(1)).alias("n"))
    totals = df.groupBy(key).agg(F.count_distinct("article_id").alias("n_key"))
    joined = own.join(totals, key).join(corpus, subject).crossJoin(n_docs)
    ratio = (F.col("n") / F.col("n_key")) / (F.col("corpus_n") / F.col("n_docs"))
    least = F.greatest(F.lit(2), F.ceil(0.03 * F.col("n_key")))
    kept = joined.withColumn("lift", ratio).where((F.col("lift") >= least_lift) & (F.col("n") >= least))
    return ranked(kept, [key], [F.desc("n"), F.asc(subject)], k).select(key, subject, "n", "lift", "rank")


def distinct_by(df: DataFrame, by: list[str], item: str, least: int = 1) -> DataFrame:
    out = df.groupBy(*by).agg(F.count_distinct(item).alias("n_distinct"))
    return out.where(F.col("n_distinct") >= least)


def distinct_sketches(df: DataFrame, by: list[str], item: str, precision: int = 14) -> DataFrame:
    """By group a sketch of its distinct items (HyperLogLog, 2 to the `precision` registers), to be stored and merged for any
    coarser groups. Null items don't count."""
    return df.groupBy(*by).agg(F.hll_sketch_agg(item, F.lit(precision)).alias("sketch"))


def merged_distinct(sketches: DataFrame, by: list[str]) -> DataFrame:
    """The number of distinct items by coarser groups of stored sketches, which never meets the items again: (by, estimate, low,
    high), with bounds of three standard errors of a merged sketch of 2 to the 14 registers."""
    n = F.hll_sketch_estimate(F.hll_union_agg("sketch"))
    out = sketches.groupBy(*by).agg(n.alias("estimate"))
    error = F.col("estimate") * (3 * 1.04 / 2**7)
    return out.withColumns({"low": F.floor(F.col("estimate") - error).cast("long"), "high": F.ceil(F.col("estimate") + error).cast("long")})


def distinct_trends(df: DataFrame, key: str, year: str, item: str, years: int = 3, peak: int = 0) -> DataFrame:
    """Distinct items by key and year, of keys with at least `years` years of which one has at least `peak` items."""
    counts = distinct_by(df, [key, year], item)
    good = counts.groupBy(key).agg(F.count(F.lit(1)).alias("y"), F.max("n_distinct").alias("p")).where((F.col("y") >= years) & (F.col("p") >= peak))
    return counts.join(good.select(key), key, "left_semi")


def filled_from(main: DataFrame, other: DataFrame, key: str, special: DataFrame) -> DataFrame:
    """(key, filled): the keys of `main`, and those of `special` that only `other` has."""
    more = other.select(key).intersect(special.select(key)).exceptAll(main.select(key).distinct())
    return main.select(key).distinct().withColumn("filled", F.lit(False)).unionByName(more.withColumn("filled", F.lit(True)))


def top_counts(df: DataFrame, column: str, k: int = 50) -> DataFrame:
    """The k most frequent values of a column; ties by value."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(k)


def nearest_rank(df: DataFrame, key: str, value: str, quantiles: dict[str, float]) -> DataFrame:
    """sorted[min(n - 1, int(q n))] of each key. Values are counted first, so that what is put in order for a key are its
    distinct values, in ranges of their own: each range's size says where it begins."""
    counts = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("__c"))
    totals = counts.groupBy(key).agg(F.sum("__c").alias("__n"), F.min(value).alias("__low"), F.max(value).alias("__high"))
    part = F.floor((F.col(value) - F.col("__low")) * 255 / F.greatest(F.col("__high") - F.col("__low"), F.lit(1e-300)))
    dealt = counts.join(totals, key).withColumn("__part", part)
    sizes = dealt.groupBy(key, "__part").agg(F.sum("__c").alias("__size"))
    begin = (F.sum("__size").over(W.partitionBy(key).orderBy("__part")) - F.col("__size")).alias("__begin")
    dealt = dealt.join(sizes.select(key, "__part", begin), [key, "__part"])
    inside = F.sum("__c").over(W.partitionBy(key, "__part").orderBy(value))
    ends = dealt.withColumn("__end", F.col("__begin") + inside)  # a value has the places from __end - __c to __end - 1
    at = lambda q: F.least(F.col("__n") - 1, F.floor(F.lit(q) * F.col("__n")))
    here = lambda q: (at(q) < F.col("__end")) & (at(q) >= F.col("__end") - F.col("__c"))
    return ends.groupBy(key).agg(*(F.max(F.when(here(q), F.col(value))).alias(c) for c, q in quantiles.items()))


def quintile(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """min(5, int(i * 5 / n) + 1) by rank within the group, which isn't ntile."""
    w = W.partitionBy(*by)
    i, n = F.row_number().over(w.orderBy(*order)) - 1, F.count(F.lit(1)).over(w)
    return df.withColumn("quintile", F.least(F.lit(5), F.floor(i * 5 / n) + 1).cast("int"))


def majority(df: DataFrame, key: str, value: str, least: int = 3, share: float = 0.9) -> DataFrame:
    """(key, value) where the key has at least `least` values and one of them holds at least `share`."""
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy(key)
    top = counts.withColumn("__all", F.sum("n").over(w))
    return top.where((F.col("__all") >= least) & (F.col("n") >= share * F.col("__all"))).select(key, value)


def feature_report(df: DataFrame, flag: Column, author: str, year: str, day: str, tie: str, authors: int = 15, recent: int = 50) -> DataFrame:
    """A feature's report in one long table (part, key, n): its records by year, its top authors, its latest records. df
    has one row for each record and author; the flag marks the feature's rows."""
    own = df.where(flag)
    records_ = own.groupBy(tie).agg(F.first(year).alias(year), F.first(day).alias(day))
    years = records_.groupBy(F.col(year).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("year").alias("part"), "key", "n")
    top = own.groupBy(F.col(author).alias("key")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "key").limit(authors)
    last = records_.orderBy(F.desc(day), tie).limit(recent)
    return years.unionByName(top.select(F.lit("author").alias("part"), "key", "n")).unionByName(
        last.select(F.lit("recent").alias("part"), F.col(tie).cast("string").alias("key"), F.lit(1).cast("long").alias("n"))
    )
