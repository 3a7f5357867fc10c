"""Evidence of annotated items: looked up, checked, and judged by who said it.

An evidence is a struct (message_ref, quote, validated, reason, role, message_id, session_id, occurred_at).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import quote_found

#: Reasons that make a ref invalid, and refs taken of an item at most.
BAD_REFS = ["invalid_evidence_ref", "invalid_message_ref", "quote_not_found"]
MAX_REFS, MAX_REVIEW_REFS = 3, 4
#: Who an item of each kind may be about, and where the user's own words are needed.
SUBJECTS = {
    "fact": ["user", "conversation", "external"], "insight": ["user", "interpretation"], "hypothesis": ["interpretation"],
    "decision": ["user"], "action": ["user"], "open_question": ["user", "conversation", "external", "interpretation"],
}
EVIDENCE = "struct<message_ref:string,quote:string,validated:boolean,reason:string,role:string,message_id:string,session_id:string,occurred_at:string>"


def check_quotes(quotes: DataFrame, messages: DataFrame, keys: list[str], ref: str = "message_ref", quote: str = "quote", content: str = "content") -> DataFrame:
    """Adds reason (null: valid) to quotes of messages: empty_quote, invalid_message_ref or quote_not_found."""
    out = quotes.join(messages.select(*keys, ref, F.col(content).alias("_content")), [*keys, ref], "left")
    blank = F.regexp_replace(F.coalesce(quote, F.lit("")), r"(?U)\s", "") == ""
    reason = F.when(blank, "empty_quote").when(F.col("_content").isNull(), "invalid_message_ref").when(~quote_found(F.col("_content"), F.col(quote)), "quote_not_found")
    return out.withColumn("reason", reason).withColumn("validated", F.col("reason").isNull()).drop("_content")


def resolve_refs(items: DataFrame, units: DataFrame, messages: DataFrame, keys: list[str], refs: str = "refs", most: int = MAX_REFS) -> DataFrame:
    """Items (with item_id and an array of refs) to the same with `evidence`, one for each of the first refs, in order.

    units: keys, ref, unit_text, unit_start, unit_end, role, message_id, and optionally session_id and occurred_at;
    messages: keys, message_id, content. A unit whose text isn't at its place in its message is not valid.
    """
    flat = items.select(*keys, "item_id", F.posexplode(F.slice(refs, 1, most)).alias("pos", "given")).withColumn("ref", F.trim("given"))
    more = [c for c in ("session_id", "occurred_at") if c in units.columns and c not in keys]
    found = flat.join(units.select(*keys, "ref", "unit_text", "unit_start", "unit_end", "role", "message_id", *more), [*keys, "ref"], "left")
    found = found.join(messages.select(*keys, "message_id", "content"), [*keys, "message_id"], "left")
    there = F.substring("content", F.col("unit_start") + 1, F.col("unit_end") - F.col("unit_start")) == F.col("unit_text")
    reason = F.when(F.col("unit_text").isNull(), "invalid_evidence_ref").when(F.col("content").isNull(), "invalid_message_ref").when(~there, "quote_not_found")
    null = F.lit(None).cast("string")
    ev = F.struct(
        F.when(F.col("unit_text").isNull(), F.col("given")).otherwise(F.col("ref")).alias("message_ref"), F.coalesce("unit_text", F.lit("")).alias("quote"), reason.isNull().alias("validated"), reason.alias("reason"), F.col("role"),
        F.when(F.col("content").isNotNull(), F.col("message_id")).cast("string").alias("message_id"), *((F.col(c).cast("string") if c in units.columns else null).alias(c) for c in ("session_id", "occurred_at")),
    )
    lists = found.groupBy(*keys, "item_id").agg(F.array_sort(F.collect_list(F.struct("pos", ev.alias("e")))).alias("_e"))
    out = items.join(lists, [*keys, "item_id"], "left")
    empty = F.array().cast(f"array<{EVIDENCE}>")
    return out.withColumn("evidence", F.coalesce(F.transform("_e", lambda x: x["e"]), empty)).drop("_e")


def has_invalid_ref(evidence: Column) -> Column:
    return F.exists(evidence, lambda e: ~e["validated"] & F.coalesce(e["reason"].isin(BAD_REFS), F.lit(False)))


def has_valid(evidence: Column) -> Column:
    return F.exists(evidence, lambda e: e["validated"])


def has_user(evidence: Column) -> Column:
    return F.exists(evidence, lambda e: e["validated"] & F.coalesce(e["role"] == "user", F.lit(False)))


def sessions_of(evidence: Column) -> Column:
    """Distinct sessions of valid evidence, in order."""
    mine = F.filter(evidence, lambda e: e["validated"] & F.coalesce(e["session_id"] != "", F.lit(False)))
    return F.array_distinct(F.transform(mine, lambda e: e["session_id"]))


def corpus(evidence: Column) -> Column:
    return F.array_join(F.transform(F.filter(evidence, lambda e: e["validated"]), lambda e: e["quote"]), "\n")


def first_day(evidence: Column) -> Column:
    mine = F.filter(evidence, lambda e: e["validated"] & F.coalesce(e["occurred_at"] != "", F.lit(False)))
    return F.array_min(F.transform(mine, lambda e: e["occurred_at"]))


def last_day(evidence: Column) -> Column:
    mine = F.filter(evidence, lambda e: e["validated"] & F.coalesce(e["occurred_at"] != "", F.lit(False)))
    return F.array_max(F.transform(mine, lambda e: e["occurred_at"]))


def unsupported_claim(kind: Column, evidence: Column, user_needed: bool = True) -> Column:
    """Facts need valid evidence; decisions and actions too, and (user_needed) the user's own."""
    firm = has_user(evidence) if user_needed else has_valid(evidence)
    return F.when(kind == "fact", ~has_valid(evidence)).when(kind.isin("decision", "action"), ~firm).otherwise(F.lit(False))


def support_reason(kind: Column, subject: Column, evidence: Column) -> Column:
    """Why the evidence doesn't support an item of this kind about this subject; null if it does."""
    allowed = reduce(lambda a, k: a | (kind == k) & subject.isin(SUBJECTS[k]), SUBJECTS, F.lit(False))
    user = kind.isin("decision", "action") | kind.isin("fact", "insight") & (subject == "user")
    role = F.when(has_valid(evidence), "evidence_role_mismatch").otherwise("missing_user_evidence")
    return F.when(~allowed, "unsupported_subject_kind").when(has_invalid_ref(evidence), "invalid_evidence_ref").when(user & ~has_user(evidence), role)
