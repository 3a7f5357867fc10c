"""Dates as YYYY-MM-DD text and instants as ISO text, with `now` always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the spotlight score.
KIND_WEIGHT = {"shift": 2.0, "connection": 1.0, "tension": 0.0}


def within(day: Column, start: str | Column | None, end: str | Column | None) -> Column:
    """Inclusive at both ends; a null or empty bound is open."""
    start, end = (F.lit(x) if isinstance(x, str) or x is None else x for x in (start, end))
    open_ = lambda x: F.coalesce(x == "", F.lit(True))
    return F.coalesce((open_(start) | (day >= start)) & (open_(end) | (day <= end)), F.lit(False))


def week_range(day: Column, back: int = 0) -> Column:
    """Monday and Sunday of the week `back` weeks before the day's."""
    monday = F.date_sub(F.date_trunc("week", day).cast("date"), 7 * back)
    return F.struct(F.date_format(monday, "yyyy-MM-dd").alias("start"), F.date_format(F.date_add(monday, 6), "yyyy-MM-dd").alias("end"))


def last_days(day: Column, n: int) -> Column:
    """The n days that end with the day."""
    return F.struct(F.date_format(F.date_sub(day, n - 1), "yyyy-MM-dd").alias("start"), F.date_format(day, "yyyy-MM-dd").alias("end"))


#: The ranges that a picker offers by name; all has no bounds.
PRESETS = ["this-week", "last-week", "last-7-days", "last-30-days", "all"]


def preset_range(preset: Column, day: Column) -> Column:
    """Start and end of a named range as seen from a day; both empty, so open, for "all" and unknown names."""
    none = F.struct(F.lit("").alias("start"), F.lit("").alias("end"))
    out = F.when(preset == "this-week", week_range(day)).when(preset == "last-week", week_range(day, 1))
    return out.when(preset == "last-7-days", last_days(day, 7)).when(preset == "last-30-days", last_days(day, 30)).otherwise(none)


def iso_instant(seconds: Column) -> Column:
    """Seconds since 1970 as YYYY-MM-DDTHH:MM:SS.mmmZ, cut to milliseconds; null for null and what isn't finite."""
    x = seconds.cast("double")
    fine = ~F.isnan(x) & (F.abs(x) < float("inf"))
    ms = F.when(fine, F.when(x < 0, F.ceil(x * 1000)).otherwise(F.floor(x * 1000)))
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def slashed(instant: Column) -> Column:
    """YYYY/MM/DD from the first 10 characters, null if they have no such form."""
    head = F.substring(instant, 1, 10)
    return F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.translate(head, "-", "/"))


def days_between(instant: Column, now: Column) -> Column:
    """Days from the instant to now, 0 at least; null if it is no instant."""
    at = F.coalesce(F.try_to_timestamp(instant), F.try_to_timestamp(F.substring(instant, 1, 10), F.lit("yyyy-MM-dd")))
    return F.greatest((F.unix_micros(now) - F.unix_micros(at)) / F.lit(86400e6), F.lit(0.0))


def thought_date(last_seen: Column, first_seen: Column) -> Column:
    return F.coalesce(last_seen, first_seen)


def spotlight_score(kind: Column, first: Column, last: Column, sessions: Column, support: Column, now: Column) -> Column:
    """How much an observation deserves to be shown: recent, of a strong kind, over many sessions, new, dated, direct."""
    dated = thought_date(last, first)
    age = days_between(dated, now)
    recent = F.coalesce(F.greatest(F.lit(0.0), 6 - age / 14), F.lit(0.0))
    weight = F.lit(0.0)
    for name, w in KIND_WEIGHT.items():
        weight = F.when(kind == name, w).otherwise(weight)
    new = F.when(days_between(first, now) <= 30, 1.5).otherwise(0.0)
    direct = F.when(F.coalesce(support == "direct", F.lit(False)) | (kind == "shift"), 0.5).otherwise(0.0)
    return recent + weight + F.least(sessions, F.lit(3)) + new + F.when(dated.isNotNull(), 1.5).otherwise(0.0) + direct


def percent(rate: Column) -> Column:
    """Whole percent, halves up."""
    return F.floor(rate * 100 + 0.5)


def spotlight_rank(kind: Column) -> Column:
    """Order of kinds of equal score."""
    return F.array_position(F.array(*map(F.lit, KIND_WEIGHT)), kind)
