"""Date functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from archivolt.functions.text import found, lookup

DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_DAY = "(monday|tuesday|wednesday|thursday|friday|saturday|sunday)"


def iso_day(stamp: Column) -> Column:
    """The date as written, whatever its offset; null where there is none."""
    return F.to_date(F.try_to_timestamp(F.left(stamp, F.lit(10)), F.lit("yyyy-MM-dd")))


def _back_to(day: Column, weekday: Column, again: bool) -> Column:
    """The last `weekday` (Monday 0) up to `day`; `again`: a week earlier where that is `day` itself."""
    step = F.pmod(F.weekday(day) - weekday, F.lit(7))
    return F.date_sub(day, F.when(step == 0, 7).otherwise(step) if again else step)


def _number(name: Column, names: tuple[str, ...]) -> Column:
    return lookup(name, {n: str(i) for i, n in enumerate(names)}).cast("int")


def mentioned_weekday(text: Column, day: Column) -> Column:
    """"on Monday": the last Monday up to `day`, itself included; "last Monday": a week before that."""
    low = F.lower(text)
    pattern = rf"\b(?:(last|on|this) )?{_DAY}\b"
    target = _number(found(low, pattern, 2), DAYS)
    on = _back_to(day, target, False)
    return F.when(F.regexp_extract(low, pattern, 1) == "last", F.date_sub(on, 7)).otherwise(on)


def mentioned_month_day(text: Column, day: Column) -> Column:
    """"Dec. 30" or "Dec. 30, 2019": that date, in the year of `day` where none is said; December on a January page is
    in the year before. Null where there is no such date."""
    low = F.lower(text)
    pattern = r"\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.? (\d{1,2})\b(?:, (\d{4})\b)?"
    month = _number(found(low, pattern, 1), MONTHS) + 1
    said = found(low, pattern, 3).cast("int")
    year = F.coalesce(said, F.year(day) - F.when((month == 12) & (F.month(day) == 1), 1).otherwise(0))
    text_date = F.format_string("%04d-%02d-%02d", year, month, found(low, pattern, 2).cast("int"))
    return F.when(month.isNotNull() & year.isNotNull(), F.to_date(F.try_to_timestamp(text_date, F.lit("yyyy-MM-dd"))))


def reference_date(text: Column, day: Column) -> Column:
    """The date a correction refers to: month and day, else a weekday before `day`, else the weekend's Sunday, else `day`."""
    low = F.lower(text)
    weekday = _number(found(low, rf"\b(?:on|last) {_DAY}\b"), DAYS)
    weekend = F.when(low.rlike(r"\b(?:this|last) weekend\b"), 6)
    target = F.coalesce(weekday, weekend)
    return F.coalesce(mentioned_month_day(text, day), _back_to(day, target, True), day)


def date_in_path(url: Column) -> Column:
    """The date of a /yyyy/mm/dd/ path."""
    return iso_day(F.replace(found(url, r"/(\d{4}/\d{2}/\d{2})/"), F.lit("/"), F.lit("-")))


def age_class(day: Column, as_of: Column) -> Column:
    """How old something is: what is likely still late, due, or lost."""
    n = F.date_diff(as_of, day)
    return F.when(n <= 14, "fresh").when(n <= 60, "pending").when(n <= 365, "overdue").otherwise("lost")
