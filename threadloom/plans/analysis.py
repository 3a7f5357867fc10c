"""The analysis of single sessions: the annotator's items, resolved, judged and counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.dates import percent
from ..operators import evidence as E
from ..operators import lists, stats

#: The order in which a page shows the kinds, and the version whose analyses a review may cite.
KINDS = ["fact", "insight", "hypothesis", "decision", "open_question", "action"]
VERSION = "analyze-session-v4"


def can_analyse(transcripts: DataFrame) -> DataFrame:
    """Adds why a session (transcript, analyzable_count) can't be analysed, null if it can. Lengths are in UTF-16 units, as the limit is."""
    units = F.octet_length(F.encode("transcript", "UTF-16BE")) / 2
    return transcripts.withColumn("reason", F.when(F.col("analyzable_count") == 0, "no_messages").when(units > lists.MAX_ANALYSIS_CHARS, "too_long"))


def analyse(items: DataFrame, units: DataFrame, messages: DataFrame, keys: list[str]) -> DataFrame:
    """Annotated items (keys, item_id, kind, subject, text, refs) with evidence, semantic_valid, invalid_reason and unsupported_claim.

    units and messages as in evidence.resolve_refs: refs without the session's number."""
    rows = E.resolve_refs(items, units, messages, keys)
    ev = F.col("evidence")
    reason = E.support_reason(F.col("kind"), F.col("subject"), ev)
    return rows.withColumns({"invalid_reason": reason, "semantic_valid": reason.isNull(), "unsupported_claim": E.unsupported_claim(F.col("kind"), ev)})


def metrics(analysed: DataFrame, keys: list[str]) -> DataFrame:
    return stats.evidence_stats(analysed, keys).join(stats.semantic_stats(analysed, keys), keys)


def payloads(analysed: DataFrame, summaries: DataFrame, keys: list[str]) -> DataFrame:
    """One row a session: its summary, items in order with all that was found about them, and the metrics."""
    item = F.struct("item_id", "kind", "subject", "text", "evidence", "semantic_valid", "invalid_reason", "unsupported_claim")
    rows = analysed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("item_id", item.alias("i")))).alias("_i")).withColumn("items", F.transform("_i", lambda x: x["i"])).drop("_i")
    return summaries.join(rows, keys, "left").join(metrics(analysed, keys), keys, "left")


def shown(analysed: DataFrame) -> DataFrame:
    """Visible items with the place of their kind on a page, and whether an insight is marked as an interpretation."""
    kind = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    many = F.col("subject").isNull() & (F.size("evidence") >= 2)
    mark = (F.col("kind") == "insight") & F.coalesce((F.col("subject") == "interpretation") | many, F.lit(False))
    return analysed.where(F.coalesce("semantic_valid", F.lit(True))).withColumns({"kind_rank": kind, "interpretive": mark})


def quality(validated: Column, evidence: Column, rate: Column, valid: Column, items: Column, item_rate: Column) -> Column:
    """The lines on quality that apply, joined."""
    semantic = F.when(items > 0, F.concat(F.lit("意味的根拠 "), valid.cast("string"), F.lit("/"), items.cast("string"), F.lit("（"), percent(item_rate).cast("long").cast("string"), F.lit("%）")))
    return F.concat_ws(" / ", L.evidence_metric(validated, evidence, rate), semantic)


def auxiliary_note(analyses: DataFrame, keys: list[str], most: int = 20) -> DataFrame:
    """What a review is given of each session's newest-version analysis: version, summary and its first visible items."""
    rows = analyses.where(F.col("prompt_version") == VERSION)
    seen = F.slice(F.filter("items", lambda i: F.coalesce(i["semantic_valid"], F.lit(True))), 1, most)
    lines = F.transform(seen, lambda i: F.concat(F.lit("- ["), i["kind"], F.when(F.coalesce(i["subject"], F.lit("")) != "", F.concat(F.lit("/"), i["subject"])).otherwise(""), F.lit("] "), i["text"]))
    head = F.array(F.concat(F.lit("promptVersion: "), "prompt_version"), F.concat(F.lit("summary: "), "summary"))
    return rows.select(*keys, F.array_join(F.concat(head, lines), "\n").alias("note"))
