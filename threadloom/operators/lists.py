"""Lookups, filters that may be left open, lists in a fixed order, and children of parents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import within
from .ranking import latest

#: Characters that an annotator may be given, and sessions that a review needs.
MAX_ANALYSIS_CHARS, MAX_REVIEW_CHARS, MAX_PACK_CHARS, MIN_REVIEW_SESSIONS = 40_000, 80_000, 20_000, 2


def by_id(rows: DataFrame, id_: str, value) -> DataFrame:
    """The row of an id; none if there is no such row."""
    return rows.where(F.col(id_) == F.lit(value)).limit(1)


def where_given(rows: DataFrame, **equal) -> DataFrame:
    """Rows whose columns have the values given; a null or empty value is left open."""
    for name, value in equal.items():
        if value is not None and value != "":
            rows = rows.where(F.col(name) == F.lit(value))
    return rows


def newest_first(rows: DataFrame, *order: str) -> DataFrame:
    """Rows in falling order; nulls come last."""
    return rows.orderBy(*(F.desc_nulls_last(c) for c in order))


def oldest_first(rows: DataFrame, *order: str) -> DataFrame:
    return rows.orderBy(*order)


def count_between(rows: DataFrame, day: str, start: str | None, end: str | None) -> DataFrame:
    return rows.where(within(F.col(day), start, end)).agg(F.count("*").alias("n"))


def counts(**tables: DataFrame) -> DataFrame:
    """(name, n) of each table."""
    each = [t.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, t in tables.items()]
    out = each[0]
    for t in each[1:]:
        out = out.unionByName(t)
    return out


def children(bridge: DataFrame, rows: DataFrame, parent: str, child: str) -> DataFrame:
    """The children of each parent with its key; their order is that of the caller (see oldest_first)."""
    return bridge.select(parent, child).join(rows, child)


def with_counts(parents: DataFrame, bridge: DataFrame, parent: str, name: str) -> DataFrame:
    """Every parent with the number of its children, 0 if it has none."""
    n = bridge.groupBy(parent).agg(F.count("*").alias(name))
    return parents.join(n, parent, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def with_latest(parents: DataFrame, rows: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """Every parent with the newest of its rows, as a struct, null if it has none."""
    newest = latest(rows, [key], at, tie)
    return parents.join(newest.select(key, F.struct(*(c for c in rows.columns if c != key)).alias("latest")), key, "left")


def gathered(bridge: DataFrame, parent: str, child: str) -> DataFrame:
    """One row a parent with the sorted array of its children."""
    return bridge.groupBy(parent).agg(F.array_sort(F.collect_list(child)).alias(f"{child}s"))


def input_checks(sessions: DataFrame, keys: list[str], chars: str = "char_count", most: int = MAX_REVIEW_CHARS, least: int = MIN_REVIEW_SESSIONS) -> DataFrame:
    """Per selection: its sessions and characters, whether these are too many, and whether it can be reviewed."""
    out = sessions.groupBy(*keys).agg(F.count("*").alias("n_sessions"), F.coalesce(F.sum(chars), F.lit(0)).alias("chars"))
    out = out.withColumn("over_limit", F.col("chars") > most)
    return out.withColumn("can_run", (F.col("n_sessions") >= least) & ~F.col("over_limit"))


def session_failures(sessions: DataFrame, sources: list[str]) -> DataFrame:
    """Adds why a session can't be created, null if it can: blank title, no day, unknown source, no text."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    day = F.coalesce(F.trim("occurred_at").rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.lit(False))
    reason = F.when(blank("title"), "missing_title").when(~day, "invalid_day").when(~F.coalesce(F.col("source").isin(sources), F.lit(False)), "invalid_source").when(F.coalesce(F.length("raw_content"), F.lit(0)) == 0, "missing_text")
    return sessions.withColumn("reason", reason)
