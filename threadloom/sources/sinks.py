"""Writes that can be repeated: what is there already isn't written again.

Spark has no transaction over several tables, and Parquet has no unique keys. So each table has one writer at a time (a scheduler or
a lock sees to that), and of tables that belong together the parents are written last: a parent that is there has all its children, and a
run that is repeated after a failure adds what is missing.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import kept
from .transcript import messages_of


def existing(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    try:
        return spark.read.schema(like.schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], like.schema)


def insert_if_absent(rows: DataFrame, path: str, keys: list[str]) -> int:
    """Appends the rows whose keys aren't there yet, each once; returns how many. A second run appends none."""
    seen = Observation()
    new = rows.dropDuplicates(keys).join(existing(rows.sparkSession, path, rows).select(*keys), keys, "left_anti").select(*rows.columns)
    new.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    return seen.get["n"]


def insert_plan(rows: DataFrame, there: DataFrame, keys: list[str], invalid: str | None = None) -> DataFrame:
    """Adds skip_reason: the one in the column `invalid`, already_there, repeated (of equal keys one is inserted), or null if the row is to
    be inserted."""
    old = there.select(*keys).distinct().withColumn("_there", F.lit(True))
    fit = F.col(invalid).isNull() if invalid else F.lit(True)
    out = rows.join(old, keys, "left").withColumn("_n", F.row_number().over(Window.partitionBy(*keys, fit).orderBy(*keys)))
    reason = F.when(F.col("_there"), "already_there").when(F.col("_n") > 1, "repeated")
    return out.withColumn("skip_reason", F.coalesce(F.col(invalid), reason) if invalid else reason).drop("_there", "_n")


def insert_with_reasons(rows: DataFrame, path: str, keys: list[str], invalid: str | None = None) -> DataFrame:
    """Appends what insert_plan lets through, and returns the plan as it was decided (kept, as the write changes the table)."""
    target = rows.drop(invalid) if invalid else rows
    plan = kept(insert_plan(rows, existing(rows.sparkSession, path, target), keys, invalid), "plan")
    plan.where("skip_reason IS NULL").select(*target.columns).write.mode("append").parquet(path)
    return plan


def write_together(tables: dict[str, tuple[DataFrame, list[str]]], root: str) -> dict[str, int]:
    """Appends rows to the tables of a store in the order given, children first; (rows, keys) by name. Returns how many each got."""
    return {name: insert_if_absent(rows, f"{root}/{name}", keys) for name, (rows, keys) in tables.items()}


def import_conversations(conversations: DataFrame, sessions: DataFrame, messages: DataFrame, root: str) -> dict[str, int]:
    """Adds conversations (source, external_id) that aren't there yet, with their sessions (session_id) and messages (session_id, index);
    sessions without messages are left out. Returns the rows that each table got, and already_imported."""
    spark, key = conversations.sparkSession, ["source", "external_id"]
    there = existing(spark, f"{root}/conversations", conversations)
    new = kept(conversations.dropDuplicates(key).join(there.select(*key), key, "left_anti"), "import")
    own = sessions.join(new.select(*key), key, "left_semi").join(messages.select("session_id"), "session_id", "left_semi")
    lines = messages.join(own.select("session_id"), "session_id", "left_semi")
    n = conversations.select(*key).distinct().count()
    done = write_together({"messages": (lines, ["session_id", "index"]), "sessions": (own, ["session_id"]), "conversations": (new, key)}, root)
    return done | {"already_imported": n - done["conversations"]}


def parsed_sessions(sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New sessions (session_id, raw_content, ...) with their status, and the messages found in their text. A text that gives no message
    leaves its session a draft."""
    rows = sessions.withColumn("_m", messages_of("raw_content"))
    lines = rows.select("session_id", F.inline("_m"))
    return rows.withColumn("status", F.when(F.size("_m") > 0, "parsed").otherwise("draft")).drop("_m"), lines


def analysis_tables(analyses: DataFrame) -> dict[str, tuple[DataFrame, list[str]]]:
    """Analyses (analysis_id, session_id, ..., items with evidence) as tables for write_together: evidences that have a message, the
    analyses themselves, and which sessions are analysed."""
    e = analyses.select("analysis_id", "session_id", F.posexplode("items").alias("item_no", "i")).select("*", F.posexplode("i.evidence").alias("n", "e")).where("e.message_id IS NOT NULL")
    evidences = e.select("analysis_id", "session_id", "item_no", "n", "e.message_id", "e.quote", "e.validated")
    status = analyses.select("session_id", F.lit("analyzed").alias("status")).distinct()
    return {"evidences": (evidences, ["analysis_id", "item_no", "n"]), "session_status": (status, ["session_id", "status"]), "analyses": (analyses, ["analysis_id"])}


def bridge_tables(parents: DataFrame, parent: str, sessions: str, name: str) -> dict[str, tuple[DataFrame, list[str]]]:
    """Parents with an array of session ids (reviews, packs, observations) as tables: the pairs, each once, and the parents."""
    pairs = parents.select(parent, F.explode(F.array_distinct(sessions)).alias("session_id"))
    return {f"{name}_sessions": (pairs, [parent, "session_id"]), f"{name}s": (parents.drop(sessions), [parent])}


def replace_partitions(rows: DataFrame, path: str, by: str) -> None:
    """Replaces the partitions that the rows have, and no others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def reparse(sessions: DataFrame, path: str) -> None:
    """Parses the sessions' texts again and replaces their messages, which are partitioned by session."""
    replace_partitions(parsed_sessions(sessions)[1], path, "session_id")


def delete_keys(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """What is left after a cascade from deleted keys."""
    return rows.join(gone.select(*keys), keys, "left_anti")


def write_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
