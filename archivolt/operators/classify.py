"""Classification of records: sections set right, features, listings, obituaries and correction pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from archivolt.functions.text import path_of

#: The section that data dumps go to, kinds of obituary, lottery headlines and other labels of the archive.
DUMPS = "Today's Paper"
OBITUARY_KINDS = ("Obituary (Obit)", "Obituary", "Obituary; Biography", "Biography; Obituary")
LOTTERY_STARTS = ("Lottery Numbers", "Winning Lottery", "Winnings Lottery", "Winning Powerball")
LOTTERY_EXACT = "Powerball and Lottery Numbers"
NOT_TEXT = ("Slideshow", "Video", "Audio")


def any_of(*conditions: Column) -> Column:
    """Whether a condition holds; null counts as false."""
    return reduce(Column.__or__, (F.coalesce(c, F.lit(False)) for c in conditions))


def starts_with_any(text: Column, starts) -> Column:
    return any_of(*(text.startswith(s) for s in starts))


def is_lottery(headline: Column) -> Column:
    return any_of(starts_with_any(headline, LOTTERY_STARTS), headline == LOTTERY_EXACT)


def is_quote_of_day(headline: Column, material: Column, section: Column) -> Column:
    return any_of(F.lower(headline).startswith("quote of the day"), (material == "Quote") & section.isin("Corrections", DUMPS))


def is_recommendation(headline: Column, kicker: Column) -> Column:
    return any_of(F.lower(headline).startswith("letter of recommendation:"), F.lower(kicker) == "letter of recommendation")


def is_correction(subjects: Column, section: Column, url: Column) -> Column:
    pattern = r"/(?:c-)?corrections?-|/pageoneplus/corrections-"
    return any_of(F.array_contains(subjects, "Correction Stories"), section == "Corrections", url.rlike(pattern))


def is_listing(headline: Column, kicker: Column, exact=(), starts=(), kickers=()) -> Column:
    return any_of(headline.isin(list(exact)), *(headline.startswith(s) for s in starts), kicker.isin(list(kickers)))


def weddings(url: Column, subsection: Column, subjects: Column, kicker: Column) -> Column:
    """{announcement, vows}: a vows column is also an announcement; small ones ("mini") are no vows."""
    kick = F.lower(F.trim(F.coalesce(kicker, F.lit(""))))
    tagged = lambda tag: F.exists(F.coalesce(subjects, F.array().cast("array<string>")), lambda s: F.lower(s) == tag)
    vows = any_of(tagged("vows (times column)"), kick == "vows", kick.endswith(": vows")) & ~kick.contains("mini")
    new = any_of(F.lower(url).endswith("-wedding.html")) & tagged("weddings and engagements")
    return F.struct(any_of(F.lower(subsection) == "weddings", vows, new).alias("announcement"), vows.alias("vows"))


def reclassify(df: DataFrame, institutions: list[str] = ()) -> DataFrame:
    """`df` (headline, section, material, authors) with `section` set right and the flags is_lottery and is_election. Each
    rule sees what the ones before it made of the section: quotes, then lottery numbers, then election results without a
    real byline go to the data section; last, every kind of obituary to its own."""
    h = F.coalesce("headline", F.lit(""))
    quote = (F.col("section") == "Corrections") & any_of(F.col("material") == "Quote", h.startswith("Quote of the Day"))
    out = df.withColumn("section", F.when(quote, DUMPS).otherwise(F.col("section")))
    out = out.withColumn("is_lottery", any_of((F.col("section") == "New York") & is_lottery(h)))
    real = F.exists(F.coalesce("authors", F.array().cast("array<string>")), lambda a: ~a.isin(list(institutions)) if institutions else F.lit(True))
    out = out.withColumn("is_election", F.lower(h).contains("election result") & ~real)
    out = out.withColumn("section", F.when(F.col("is_lottery") | F.col("is_election"), DUMPS).otherwise(F.col("section")))
    return out.withColumn("section", F.when(F.col("material").isin(*OBITUARY_KINDS), "Obituaries").otherwise(F.col("section")))


def obituaries(
    df: DataFrame, strong_url: str = r"/obituaries/", reject_url: str = r"/(?:slideshow|video|learning)/", group: str = r"(?i)^(?:the lives they lived|deaths? last week)",
    death: str = r"(?i)\b(?:dies|dead|died|killed|slain)\b", hint_url: str = r"(?:-dies|-dead|obit)", series: str = r"(?i)^overlooked no more", known: list[str] = (),
    portraits: str = r"(?i)portraits of grief",
) -> DataFrame:
    """Rows (headline, section, desk, material, url) that are obituaries: by kind, desk, section, series or path; neither
    corrections, nor media, nor group pieces; and with a sign of death, unless a portrait or known by its path."""
    path, h = path_of(F.col("url")), F.coalesce("headline", F.lit(""))
    portrait = any_of(F.col("desk").rlike(portraits))
    material = F.coalesce("material", F.lit(""))
    named = any_of(material.isin(*OBITUARY_KINDS), F.col("desk") == "Obits", F.col("section") == "Obituaries", portrait, path.rlike(strong_url))
    rejected = any_of(material == "Correction", material.isin(*NOT_TEXT), path.rlike(reject_url), h.rlike(group))
    signs = any_of(portrait, path.isin(list(known)), h.rlike(death), path.rlike(hint_url), h.rlike(series))
    return df.where(named & ~rejected & signs)


def correction_pages(df: DataFrame) -> DataFrame:
    """(url, day, headline) of the daily pages: two taggings of one path, without quotes and empty days; one row a url."""
    low = F.lower("url")
    path = low.contains("corrections-") & ~low.contains("/no-corrections-")
    kind, section = F.coalesce(F.trim("material"), F.lit("")), F.coalesce(F.trim("section"), F.lit(""))
    tagged = (kind == "Correction") | ((section == "Corrections") & (kind != "Quote"))
    return df.where(path & tagged).groupBy("url").agg(F.min_by(F.struct("day", "headline"), "day").alias("r")).select("url", "r.*")


def attach_republished(df: DataFrame, key: str, order: list[Column], url: str = "url", day: str = "day", flag: str = "republished") -> DataFrame:
    """Republications of one key go to its best original by `order` (values that ascend); without an original, to the oldest of them. They
    leave the table and stand in the `later` array of the row that stays; other originals stay as they are. A key's rows
    are aggregated, not ordered: the best original, the oldest republication, and a list of the republications, which is
    the result's own."""
    stay, at = F.struct(F.col(day).alias("day"), F.col(url).alias("url")), "__k"
    ranked = F.struct(F.col(flag), *order, stay)
    again = F.when(F.col(flag), stay)
    groups = df.groupBy(F.col(key).alias(at)).agg(
        F.min(flag).alias("__none"), F.min_by(stay, ranked).alias("__best"), F.min(stay).alias("__oldest"),
        F.sort_array(F.collect_list(again)).alias("__again"),
    )
    heads = groups.select(at, F.when(F.col("__none"), F.col("__oldest")).otherwise(F.col("__best")).alias("__head"), "__again")
    rows = df.join(heads, F.col(key).eqNullSafe(F.col(at)))
    first = (F.col(day) == F.col("__head.day")) & (F.col(url) == F.col("__head.url"))
    nothing = F.array().cast(f"array<struct<day:{dict(df.dtypes)[day]},url:string>>")
    later = F.when(first, F.filter("__again", lambda r: r != F.col("__head"))).otherwise(nothing)
    return rows.where(~F.col(flag) | first).withColumn("later", later).drop(at, "__head", "__again")


def serving(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """A narrow projection under short names; empty arrays and texts become null, which Parquet stores for nothing."""
    kinds = dict(df.dtypes)

    def sparse(c: str) -> Column:
        if kinds[c].startswith("array"):
            return F.when(F.size(c) > 0, F.col(c))
        return F.nullif(F.col(c), F.lit("")) if kinds[c] == "string" else F.col(c)

    return df.select(*(sparse(c).alias(short) for c, short in names.items()))


def search(df: DataFrame, headline: str, words: str) -> DataFrame:
    """Rows whose headline holds the words, in any case."""
    return df.where(F.contains(F.lower(headline), F.lower(F.lit(words))))


def rescale(df: DataFrame, total: str, scaled: str, parts: list[str]) -> DataFrame:
    """`parts` by the factor that took `total` to `scaled`, half-even; 0 where there is nothing to scale."""
    by = lambda p: F.when((F.col(total) > 0) & (F.col(p) > 0), F.bround(F.col(scaled) * F.col(p) / F.col(total), 0).cast("long")).otherwise(0)
    return df.withColumns({f"{p}_scaled": by(p) for p in parts})
