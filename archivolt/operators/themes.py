"""Place by tag: counts, lift scores, and the split of recurring from episodic themes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from archivolt.functions.text import lookup
from archivolt.operators.marts import ranked


#: Other names under which a place is asked for.
PLACE_ALIASES = {
    "United Kingdom": "Great Britain", "UK": "Great Britain", "Britain": "Great Britain", "Czechia": "Czech Republic",
    "Côte d'Ivoire": "Ivory Coast", "Cote d Ivoire": "Ivory Coast", "DRC": "Democratic Republic of Congo", "USA": "United States",
    "U.S.": "United States",
}


def canonical_place(place: Column, aliases: dict[str, str] | None = None) -> Column:
    """The place that a request means: what its name is an alias of, or the name itself."""
    return F.coalesce(lookup(place, PLACE_ALIASES if aliases is None else aliases), place)


def clean_places(rows: DataFrame, place: str, stop: list[str] = (), merges: dict[str, str] | None = None) -> DataFrame:
    """`rows` without the places of a stop list, and with places that are parts or old names of another under that name."""
    kept = rows.where(~F.col(place).isin(list(stop))) if stop else rows
    return kept.withColumn(place, F.coalesce(lookup(F.col(place), merges or {}), F.col(place)))


def place_tags(rows: DataFrame, tags: DataFrame, place: str = "place", year: str = "yr", tag: str = "subject") -> DataFrame:
    """Records by place, tag and year."""
    return tags.join(rows.select("article_id", place, year), "article_id").groupBy(place, tag, year).agg(F.count(F.lit(1)).alias("n"))


def corpus_baseline(rows: DataFrame, tags: DataFrame, tag: str = "subject") -> tuple[DataFrame, DataFrame]:
    """(tag frequencies, one row with the number of records)."""
    known = tags.join(rows.select("article_id"), "article_id", "left_semi")
    return known.groupBy(tag).agg(F.count(F.lit(1)).alias("freq")), rows.agg(F.count(F.lit(1)).alias("corpus"))


def bursts(counts: DataFrame, place: str, tag: str, year: str, share: float, least: int = 5) -> DataFrame:
    """Per place and tag: n, years, and is_event where one year or two adjacent ones hold over `share` of at least `least`."""
    w = W.partitionBy(place, tag).orderBy(year)
    pair = F.when(F.lead(year).over(w) == F.col(year) + 1, F.col("n") + F.lead("n").over(w))
    out = counts.withColumn("__p", pair).groupBy(place, tag).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("years"), F.greatest(F.max("n"), F.coalesce(F.max("__p"), F.lit(0))).alias("__peak")
    )
    return out.withColumn("is_event", (F.col("n") >= least) & (F.col("__peak") / F.col("n") > share)).drop("__peak")


def themes(
    counts: DataFrame, rows: DataFrame, frequency: DataFrame, corpus: DataFrame, place: str = "place", tag: str = "subject",
    year: str = "yr", min_count: int = 5, min_pct: float = 0.5, min_years: int = 2, burst: float = 0.85, generic: list[str] = (),
    events: list[str] = (), recurring: int = 8, episodic: int = 6,
) -> DataFrame:
    """The best themes of every place by lift over the corpus: up to `recurring` that come back in `min_years` years and
    up to `episodic` events (named ones, a bare year in the tag, or a burst). Filter by place to serve one request."""
    totals = rows.groupBy(place).agg(F.count(F.lit(1)).alias("total"))
    found = bursts(counts.where(~F.col(tag).isin(list(generic))) if generic else counts, place, tag, year, burst)
    scored = found.join(totals, place).join(frequency, tag).crossJoin(corpus)
    pct = 100 * F.col("n") / F.col("total")
    named = F.col(tag).isin(list(events)) if events else F.lit(False)
    dated = F.col(tag).rlike(r"\b(?:19|20)\d{2}\b(?!\s*[-–])") | F.col(tag).rlike(r"\b(?:199\d|20\d\d)\s*[-–]\s*[\d)]")  # a year, or years
    kept = scored.withColumns({
        "pct": pct,
        "score": (F.col("n") / F.col("total")) / (F.col("freq") / F.col("corpus")),
        "is_event": F.col("is_event") | named | dated,
    }).where((F.col("n") >= min_count) & (F.col("pct") >= min_pct) & (F.col("is_event") | (F.col("years") >= min_years)))
    top = ranked(kept, [place, "is_event"], [F.desc("score"), F.asc(tag)], max(recurring, episodic))
    return top.where(F.col("rank") <= F.when(F.col("is_event"), episodic).otherwise(recurring))
