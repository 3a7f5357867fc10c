"""Evidence units: the addressable pieces of messages."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

#: Fixed value: a unit ends at the first break at least so many characters on.
MIN_CHARS = 20
#: Breaks: after a newline or a full-width stop, and after . ! ? with the spaces that follow, but not within a number.
_BREAK = re.compile(r"\n|[。！？]|(?:[!?]|(?<![0-9])\.|(?<=[0-9])\.(?![0-9])) *")
#: White space by the wide definition of functions.text.
_SPACE = "\t\n\x0b\x0c\r \xa0                　﻿"
_UNIT = StructType([StructField("text", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())])
_UNITS = pa.list_(pa.struct([("text", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def split_text(content: str) -> list[dict]:
    ends = [m.end() for m in _BREAK.finditer(content)]
    out, at, n = [], 0, 0
    while at < len(content):
        if content[at] in _SPACE:
            at += 1
            continue
        while n < len(ends) and ends[n] < at + MIN_CHARS:
            n += 1
        stop = ends[n] if n < len(ends) else len(content)
        text = content[at:stop].rstrip(_SPACE)
        out.append({"text": text, "start": at, "end": at + len(text)})
        at = stop
    return out


@F.arrow_udf(ArrayType(_UNIT))
def units_of(content: pa.Array) -> pa.Array:
    """Some texts at a time are Python objects; a batch of 10,000 has them in Arrow only."""
    parts = [pa.array([split_text(c or "") for c in content.slice(i, 128).to_pylist()], _UNITS) for i in range(0, len(content), 128)]
    return pa.concat_arrays(parts) if parts else pa.array([], _UNITS)


def normal_role(role: Column) -> Column:
    lower = F.lower(F.trim(role))
    return F.when(lower.isin("user", "assistant"), lower).otherwise("unknown")


def numbered_messages(messages: DataFrame, keys: list[str], order: list[str], role: str = "role") -> DataFrame:
    """User and assistant messages with message_no (from 1, over both roles) and message_ref (M001)."""
    rows = messages.withColumn(role, normal_role(F.col(role))).where(F.col(role).isin("user", "assistant"))
    rows = rows.withColumn("message_no", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return rows.withColumn("message_ref", F.format_string("M%03d", "message_no"))


def evidence_units(messages: DataFrame, keys: list[str], order: list[str], content: str = "content", role: str = "role", roles: tuple[str, ...] = ("user", "assistant"), session_no: str | None = None) -> DataFrame:
    """A row per unit: its text, start and end in the message, and ref (M001:E01, after S01: if sessions are numbered).
    Messages of other roles still count for the numbers."""
    rows = numbered_messages(messages, keys, order, role).where(F.col(role).isin(*roles))
    rows = rows.select("*", F.posexplode(units_of(F.col(content))).alias("pos", "unit"))
    ref = F.concat(F.col("message_ref"), F.lit(":"), F.format_string("E%02d", F.col("pos") + 1))
    if session_no:
        ref = F.concat(F.format_string("S%02d:", F.col(session_no)), ref)
    return rows.select("*", ref.alias("ref"), (F.col("pos") + 1).alias("unit_no"), F.col("unit.text").alias("unit_text"), F.col("unit.start").alias("unit_start"), F.col("unit.end").alias("unit_end")).drop("pos", "unit")


def parse_ref(ref: Column) -> Column:
    """Numbers from 0 of S01:M003:E02 or M003:E02; null if it is neither."""
    pattern = r"(?i)^(?:S(\d+):)?M(\d+):E(\d+)$"
    part = lambda i: F.try_to_number(F.nullif(F.regexp_extract(F.trim(ref), pattern, i), F.lit("")), F.lit("999999999")).cast("int") - 1
    return F.when(F.trim(ref).rlike(pattern), F.struct(part(1).alias("session"), part(2).alias("message"), part(3).alias("unit")))


def numbered_sessions(sessions: DataFrame, at: str = "occurred_at", created: str = "created_at", id_: str = "id") -> DataFrame:
    """Adds session_no, in order of day, creation and id. All sessions of one review; partition first if there are more."""
    return sessions.withColumn("session_no", F.row_number().over(Window.partitionBy("review_id").orderBy(at, created, id_)))


def _in_order(parts: list[str], line: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(*parts, line.alias("_l")))), lambda x: x["_l"])


def labelled_transcript(messages: DataFrame, units: DataFrame, keys: list[str]) -> DataFrame:
    """What an annotator reads of a session: a head line for each numbered message, its units with their refs, and a line on attachments.

    messages: keys, message_no, message_ref, role and optionally attached; units: keys, message_no, unit_no, ref, unit_text."""
    role = F.upper("role")
    lines = units.groupBy(*keys, "message_no").agg(F.array_join(_in_order(["unit_no"], F.concat(F.lit("["), "ref", F.lit("]["), role, F.lit("]\n"), "unit_text")), "\n\n").alias("_units"))
    attached = F.when(F.col("attached"), "（添付ファイルあり）") if "attached" in messages.columns else F.lit(None).cast("string")
    block = F.concat_ws("\n\n", F.concat(F.lit("["), role, F.lit(" MESSAGE "), "message_ref", F.lit("]")), "_units", attached)
    return messages.join(lines, [*keys, "message_no"], "left").groupBy(*keys).agg(F.array_join(_in_order(["message_no"], block), "\n\n").alias("transcript"), F.count("*").alias("analyzable_count"))


def plain_transcript(messages: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """The older form: a block `[S1:M001][ROLE]` with the whole text for each numbered message."""
    note = F.when(F.col("attached"), "\n（添付ファイルあり）").otherwise("") if "attached" in messages.columns else F.lit("")
    block = F.concat(F.lit("[S1:"), "message_ref", F.lit("]["), F.upper("role"), F.lit("]\n"), content, note)
    return messages.groupBy(*keys).agg(F.array_join(_in_order(["message_no"], block), "\n\n").alias("transcript"))


def user_units_text(units: DataFrame, keys: list[str]) -> DataFrame:
    """The user's units as an annotator of concepts reads them."""
    line = F.concat(F.lit("["), "ref", F.lit("][USER] "), "unit_text")
    return units.groupBy(*keys).agg(F.array_join(_in_order(["message_no", "unit_no"], line), "\n\n").alias("units_text"))


def review_transcript(sessions: DataFrame, units: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """What an annotator reads of a review: its sessions in order, each with title, day and labelled units.

    sessions: review_id, session_no, title, occurred_at; units: review_id, session_no, message_no, unit_no, ref, role,
    unit_text and optionally attached (whether the message has attachments, told after its last unit); notes: review_id,
    session_no, note (an analysis that is no evidence). Sessions without units are left out.
    """
    keys = ["review_id", "session_no"]
    attached = F.col("attached") if "attached" in units.columns else F.lit(False)
    last = F.col("unit_no") == F.max("unit_no").over(Window.partitionBy(*keys, "message_no"))
    line = F.concat(F.lit("["), "ref", F.lit("]["), F.upper("role"), F.lit("]\n"), "unit_text", F.lit("\n"), F.when(attached & last, "\n（添付ファイルあり）\n").otherwise(""))
    lines = units.withColumn("_line", line).groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("message_no", "unit_no", "_line"))), lambda x: x["_line"]), "\n").alias("_body"))
    number = F.format_string("S%02d", "session_no")
    head = F.concat(F.lit("====================\nSESSION "), number, F.lit("\n===========\n\nTitle:\n"), "title", F.lit("\n\nDate:\n"), F.replace("occurred_at", F.lit("-"), F.lit("/")), F.lit("\n\n"))
    rows = sessions.join(lines, keys)
    tail = F.lit("")
    if notes is not None:
        rows = rows.join(notes, keys, "left")
        tail = F.when(F.col("note").isNotNull(), F.concat(F.lit("\n----- SessionAnalysis (reference only / NOT evidence) -----\n"), "note", F.lit("\n"))).otherwise("")
    block = F.concat(head, "_body", tail).alias("_b")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("session_no", block))), lambda x: x["_b"]), "\n")
    return rows.groupBy("review_id").agg(F.regexp_replace(whole, r"\s+\z", "").alias("transcript"), F.count("*").alias("session_count"))


def context_note(sessions: DataFrame) -> DataFrame:
    """A line on the newest session of each review, and one on the oldest if it is another."""
    name = lambda s: F.concat(F.format_string("S%02d", s["session_no"]), F.lit("（"), F.replace(s["occurred_at"], F.lit("-"), F.lit("/")), F.lit(" / "), s["title"], F.lit("）。"))
    rows = sessions.groupBy("review_id").agg(F.max(F.struct("session_no", "occurred_at", "title")).alias("n"), F.min(F.struct("session_no", "occurred_at", "title")).alias("o"))
    newest = F.concat(F.lit("最も新しいSessionは "), name(F.col("n")))
    oldest = F.when(F.col("o.session_no") != F.col("n.session_no"), F.concat(F.lit("最も古いSessionは "), name(F.col("o"))))
    return rows.select("review_id", F.concat_ws("\n", newest, oldest).alias("note"))
