"""Sessions of a conversation: splitting by time gap, titles, and transcripts with offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Presets of the gap, in hours, and the default.
GAP_HOURS, DEFAULT_GAP = (3, 5, 8, 12, 24), 5


def gap_sessions(rows: DataFrame, keys: list[str], order: list[str], at: str, gap_seconds: float | None = DEFAULT_GAP * 3600) -> DataFrame:
    """Adds `session`, from 0 for each of `keys`: a new one begins where both instants are known and at least the gap
    lies between them. The order is the rows' own, not that of time. Without a positive gap all is one session."""
    if not gap_seconds or gap_seconds < 0:
        return rows.withColumn("session", F.lit(0).cast("long"))
    w = Window.partitionBy(*keys).orderBy(*order)
    here = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{at}`)") / 1e6 if dict(rows.dtypes)[at].startswith("timestamp") else F.col(at)
    cut = (here - F.lag(here).over(w)) >= gap_seconds
    rows = rows.withColumn("_cut", F.when(cut, 1).otherwise(0))
    return rows.withColumn("session", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_cut")


def session_spans(rows: DataFrame, keys: list[str], order: list[str], at: str) -> DataFrame:
    """One row a session: number of messages, and the instants of its first and last in the rows' order."""
    place = F.struct(*order)
    return rows.groupBy(*keys, "session").agg(F.count("*").alias("n_messages"), F.min_by(at, place).alias("start_at"), F.max_by(at, place).alias("end_at"))


def session_titles(sessions: DataFrame, keys: list[str], title: Column, at: Column, now: Column) -> DataFrame:
    """Adds `title`: that of the conversation, the date, and #n for the n-th session of that date."""
    day = F.date_format(F.coalesce(at, now), "yyyy/MM/dd")
    sessions = sessions.withColumn("_day", day)
    nth = F.row_number().over(Window.partitionBy(*keys, "_day").orderBy("session"))
    more = F.when(nth > 1, F.concat(F.lit(" #"), nth.cast("string"))).otherwise("")
    return sessions.withColumn("title", F.concat(title, F.lit(" — "), F.col("_day"), more)).drop("_day")


def transcript_offsets(messages: DataFrame, keys: list[str], order: list[str], role: str = "role", content: str = "content") -> DataFrame:
    """Adds where each message stands in its session's transcript: char_start and char_end, in code points."""
    label = F.when(F.col(role) == "user", "User:\n").otherwise("Assistant:\n")
    w = Window.partitionBy(*keys).orderBy(*order)
    gap = F.when(F.row_number().over(w) > 1, 2).otherwise(0)
    messages = messages.withColumns({"_label": label, "_gap": gap})
    size = F.col("_gap") + F.length("_label") + F.length(content)
    end = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return messages.withColumn("char_end", end).withColumn("char_start", F.col("char_end") - F.length(content)).drop("_label", "_gap")


def transcripts(messages: DataFrame, keys: list[str], order: list[str], role: str = "role", content: str = "content") -> DataFrame:
    """One row a session: its transcript, messages separated by a blank line. A session is as long as one conversation."""
    piece = F.concat(F.when(F.col(role) == "user", "User:\n").otherwise("Assistant:\n"), F.col(content))
    pieces = F.array_sort(F.collect_list(F.struct(*order, piece.alias("piece"))))
    return messages.groupBy(*keys).agg(F.array_join(F.transform(pieces, lambda p: p["piece"]), "\n\n").alias("raw_content"), F.count("*").alias("n_messages"))


def broken_anchors(slices: DataFrame, whole: str, start: str, end: str, text: str) -> DataFrame:
    """Rows whose text is not what stands between its offsets; there should be none."""
    cut = F.substring(F.col(whole), F.col(start).cast("int") + 1, (F.col(end) - F.col(start)).cast("int"))
    return slices.where((F.col(start) < 0) | (F.col(end) > F.length(whole)) | ~cut.eqNullSafe(F.col(text)))
