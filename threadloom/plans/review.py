"""Integrated reviews: the annotator's items, limited and judged by section, with the figures of a review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import guards, stats
from ..operators import evidence as E
from ..operators.evidence import sessions_of

#: Items of a section at most (the others have no limit), and what supports a section's items.
LIMITS = {"themes": 3, "insights": 3, "hypotheses": 2, "open_questions": 5, "next_questions": 3}
SUPPORT = {"themes": "cross_session_interpretation", "tensions": "cross_session_interpretation", "insights": "cross_session_interpretation", "hypotheses": "hypothesis", "shifts": "direct", "open_questions": "direct"}
SECTIONS = ["themes", "shifts", "tensions", "insights", "hypotheses", "open_questions", "next_questions"]


def _map(values: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key)


def ordered_refs(*groups: Column) -> Column:
    """The refs of all groups, trimmed, without blanks, each once at its first place."""
    text = F.transform(F.concat(*(F.coalesce(g, F.array().cast("array<string>")) for g in groups)), lambda r: F.trim(r))
    return F.array_distinct(F.filter(text, lambda r: F.coalesce(r != "", F.lit(False))))


def ref_sessions(refs: Column) -> Column:
    """The distinct session parts (S01) of refs, in order."""
    found = F.transform(refs, lambda r: F.regexp_extract(r, r"^(S\d+):", 1))
    return F.array_distinct(F.filter(found, lambda s: s != ""))


def judge(items: DataFrame, sessions: DataFrame) -> DataFrame:
    """Adds valid, reason, guard_type, support_type and distinct_session_count to the items within their section's limit.

    items: review_id, section, pos (from 0), text, evidence and, for sections that have them, side_a, side_b, before and
    after (evidence too); sessions: review_id, session_id, session_no. Shifts are judged by their sides, and insights
    that say what a valid theme of the review says are not valid.
    """
    rows = items.where(F.col("pos") < F.coalesce(_map(LIMITS, F.col("section")), F.lit(1 << 30)))
    order = sessions.groupBy("review_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("session_no", "session_id"))), lambda s: s["session_id"]).alias("_order"))
    rows = rows.join(order, "review_id", "left")
    text, ev = F.col("text"), F.col("evidence")
    by_section = {
        "themes": guards.theme(text, ev), "shifts": guards.shift(F.col("before"), F.col("after"), F.col("_order")), "tensions": guards.tension(text, ev, F.col("side_a"), F.col("side_b")),
        "insights": guards.tension(text, ev), "hypotheses": guards.hypothesis(text, ev), "open_questions": guards.open_question(ev), "next_questions": guards.next_question(text, ev),
    }
    verdict = F.lit(None)
    for section, v in by_section.items():
        verdict = F.when(F.col("section") == section, v).otherwise(verdict)
    rows = rows.withColumn("_v", verdict)
    themes = F.collect_list(F.when((F.col("section") == "themes") & F.col("_v.valid"), F.col("text"))).over(Window.partitionBy("review_id"))
    rows = rows.withColumn("_themes", themes)  # three texts a review at most
    rows = rows.withColumn("_v", F.when(F.col("section") == "insights", guards.duplicate_insight(F.col("_v"), text, F.col("_themes"))).otherwise(F.col("_v")))
    counted = ~F.col("section").isin("open_questions", "next_questions")
    return rows.select(*items.columns, F.col("_v.valid").alias("semantic_valid"), F.col("_v.reason").alias("invalid_reason"), F.col("_v.guard_type").alias("guard_type"), _map(SUPPORT, F.col("section")).alias("support_type"), F.when(counted, F.size(sessions_of(ev))).alias("distinct_session_count"))


def metrics(judged: DataFrame) -> DataFrame:
    """The figures of each review: evidence, items by validity, and by guard."""
    out = stats.evidence_stats(judged, ["review_id"])
    for other in (stats.semantic_stats(judged, ["review_id"]), stats.guard_stats(judged, ["review_id"])):
        out = out.join(other, "review_id", "left")
    return out


def evidence_rows(judged: DataFrame) -> DataFrame:
    """A row for each evidence that has a message and a session."""
    e = judged.select("review_id", "section", "pos", F.posexplode("evidence").alias("n", "e"))
    return e.where("e.message_id IS NOT NULL AND e.session_id IS NOT NULL").select("review_id", "section", "pos", "n", "e.session_id", "e.message_id", "e.quote", "e.validated")


def shown(judged: DataFrame) -> DataFrame:
    """What a page shows of each section: visible items, and hidden ones by guard (a missing guard counts as interpretation)."""
    seen, hard = F.coalesce("semantic_valid", F.lit(True)), F.coalesce(F.col("guard_type") == "hard", F.lit(False))
    count = lambda c: F.count_if(c)
    return judged.groupBy("review_id", "section").agg(count(seen).alias("visible"), count(~seen & hard).alias("hidden_hard"), count(~seen & ~hard).alias("hidden_interpretation"))


def levels(judged: DataFrame) -> DataFrame:
    """Which of the three levels of a review's page have anything to show: changes, what sessions have in common, what is open."""
    seen = F.coalesce("semantic_valid", F.lit(True))
    has = lambda *sections: F.count_if(seen & F.col("section").isin(*sections)) > 0
    return judged.groupBy("review_id").agg(has("shifts").alias("level1"), has("themes", "tensions", "insights").alias("level2"), has("hypotheses", "open_questions", "next_questions").alias("level3"))


def quality_line(figures: DataFrame) -> DataFrame:
    """One line on the quality of each review, from its metrics; figures that don't apply are left out."""
    c = F.col
    excluded = L.hard_excluded(c("hard_excluded_count"), c("hard_item_count"), c("hard_valid_count"))
    hard = F.when(excluded.isNotNull(), F.concat(F.lit("Hard Guard除外 "), excluded.cast("string"), F.lit("件")))
    line = F.concat_ws(" · ", L.evidence_metric(c("validated_count"), c("evidence_count"), c("validation_rate")), L.interpretation_metric(c("interpretation_valid_count"), c("interpretation_item_count"), c("interpretation_validation_rate")), hard)
    return figures.select("review_id", line.alias("quality"))


def run(items: DataFrame, sessions: DataFrame, units: DataFrame, messages: DataFrame) -> DataFrame:
    """Annotated items (review_id, section, pos, text, refs and for sections that have them side_a_refs, side_b_refs, before_refs, after_refs)
    to judged ones. sessions: review_id, session_id, session_no, occurred_at; units (with refs that name the session) and messages as in
    evidence.resolve_refs, with review_id."""
    keyed = items.withColumn("item_id", F.concat_ws(":", "section", F.col("pos").cast("string")))
    out = E.resolve_refs(keyed, units, messages, ["review_id"], most=E.MAX_REVIEW_REFS)
    for part in ("side_a", "side_b", "before", "after"):
        refs = F.coalesce(f"{part}_refs", F.array().cast("array<string>"))
        one = E.resolve_refs(keyed.select("review_id", "item_id", refs.alias("refs")), units, messages, ["review_id"], most=E.MAX_REVIEW_REFS)
        out = out.join(one.select("review_id", "item_id", F.col("evidence").alias(part)), ["review_id", "item_id"])
    return judge(out.drop("item_id", "refs", *(f"{p}_refs" for p in ("side_a", "side_b", "before", "after"))), sessions)
