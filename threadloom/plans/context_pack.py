"""Context packs: chosen pieces of a review, by type and limit, written out as Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import lists
from ..operators.evidence import has_invalid_ref, has_user
from ..operators.joins import resolve_refs

#: The section and limit of each type, words that make a fact one about constraints or tools, facts a session.
SECTIONS = {"current_state": (["summary", "shift"], 4), "confirmed_context": (["decision", "user_fact"], 5), "cross_session_insights": (["insight", "theme"], 3), "tensions": (["tension"], 2), "hypotheses": (["hypothesis"], 2), "open_questions": (["open_question", "next_question"], 3)}
FACT_HINTS = ["制約", "ツール", "使用中", "使っている", "使わない", "採用", "方針", "Cursor", "ChatGPT", "Claude", "MVP", "スコープ"]
MAX_FACTS = 3
CONSTANTS = ["C:PROJECT_NAME", "C:CORE_PURPOSE"]
TITLES = {"current_state": "現在地", "confirmed_context": "これまでに確認された方針", "cross_session_insights": "複数Sessionから見えてきたこと", "tensions": "緊張関係・注意点", "hypotheses": "仮説", "open_questions": "未解決の問い"}


def analysis_candidates(items: DataFrame) -> DataFrame:
    """Decisions with the user's own evidence, and up to three facts a session about the user's constraints and tools.

    items: review_id, session_no, pos, kind, subject, text, evidence, unsupported_claim, semantic_valid, and optionally the session's
    session_id, session_title and occurred_at, which go along.
    """
    more = [c for c in ("session_id", "session_title", "occurred_at") if c in items.columns]
    ok = F.coalesce("semantic_valid", F.lit(True)) & ~F.coalesce("unsupported_claim", F.lit(False)) & ~has_invalid_ref(F.col("evidence")) & has_user(F.col("evidence"))
    fact = (F.col("kind") == "fact") & (F.coalesce("subject", F.lit("user")) == "user") & F.exists(F.array(*map(F.lit, FACT_HINTS)), lambda h: F.col("text").contains(h))
    rows = items.where(ok & ((F.col("kind") == "decision") | fact)).withColumn("type", F.when(F.col("kind") == "decision", "decision").otherwise("user_fact"))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("review_id", "session_no", "type").orderBy("pos")))
    rows = rows.where((F.col("type") == "decision") | (F.col("nth") <= MAX_FACTS))
    ref = F.format_string("%s:S%02d:%02d", F.when(F.col("type") == "decision", "D").otherwise("F"), "session_no", "nth")
    return rows.select("review_id", ref.alias("ref"), "type", "text", F.lit("confirmed").alias("support_type"), *more)


#: What items of some sections have besides their text, and the word of each section in refs.
NESTED = ["before", "after", "side_a", "side_b", "rationale", "validation_idea"]
WORDS = {"shifts": "SHIFT", "themes": "THEME", "tensions": "TENSION", "insights": "INSIGHT", "hypotheses": "HYPOTHESIS", "open_questions": "OPEN", "next_questions": "NEXT"}
#: Sections of a review in order, with their type, ref and support.
REVIEW_TYPES = {
    "shifts": ("shift", "confirmed"), "themes": ("theme", "cross_session_interpretation"), "tensions": ("tension", "cross_session_interpretation"),
    "insights": ("insight", "cross_session_interpretation"), "hypotheses": ("hypothesis", "hypothesis"), "open_questions": ("open_question", "open_question"), "next_questions": ("next_question", "open_question"),
}


def review_candidates(reviews: DataFrame, items: DataFrame, refs: dict[str, str], project: str, purpose: str) -> DataFrame:
    """The two constants, the summary and the visible items of each review: review_id, ref, type, text, support_type.

    reviews: review_id, summary; items: review_id, section, pos (from 0, hidden ones counted), text, semantic_valid; refs: the
    word of each section in refs (R:WORD:01).
    """
    fixed = [(CONSTANTS[0], "current_context", F.lit(project)), (CONSTANTS[1], "current_context", F.lit(purpose)), ("R:SUMMARY", "summary", F.col("summary"))]
    heads = [reviews.select("review_id", F.lit(r).alias("ref"), F.lit(t).alias("type"), x.alias("text"), F.lit("confirmed").alias("support_type")) for r, t, x in fixed]
    at = lambda i: F.element_at(F.create_map(*(F.lit(x) for k, v in REVIEW_TYPES.items() for x in (k, v[i]))), F.col("section"))
    word = F.element_at(F.create_map(*(F.lit(x) for kv in refs.items() for x in kv)), F.col("section"))
    rows = items.where(F.coalesce("semantic_valid", F.lit(True)) & F.col("section").isin(list(REVIEW_TYPES)))
    shift = F.col("section") == "shifts"
    have = lambda c: F.col(c) if c in items.columns else F.lit(None).cast("string")
    text = F.when(shift, F.coalesce(have("interpretation"), "text")).otherwise(F.col("text"))
    more = [F.when(shift, have(c)).alias(c) for c in ("before", "after")] + [F.when(~shift, have(c)).alias(c) for c in ("side_a", "side_b", "rationale", "validation_idea")]
    out = rows.select("review_id", F.format_string("R:%s:%02d", word, F.col("pos") + 1).alias("ref"), at(0).alias("type"), text.alias("text"), at(1).alias("support_type"), *(m for m, c in zip(more, NESTED, strict=True) if c in items.columns))
    for h in heads:
        out = out.unionByName(h, allowMissingColumns=True)
    return out


def candidates(reviews: DataFrame, items: DataFrame, analysed: DataFrame, project: str, purpose: str) -> DataFrame:
    """All candidates of each review: constants, summary, its visible items, and decisions and facts from its sessions' analyses."""
    return review_candidates(reviews, items, WORDS, project, purpose).unionByName(analysis_candidates(analysed), allowMissingColumns=True)


def source_checks(texts: DataFrame) -> DataFrame:
    """Adds whether a review's candidates are too long to choose from, in UTF-16 units as the limit is."""
    return texts.withColumn("too_long", F.octet_length(F.encode("candidate_text", "UTF-16BE")) / 2 > lists.MAX_PACK_CHARS)


def pack_title(sessions: DataFrame) -> DataFrame:
    """A title for each review's pack, from the days of its sessions."""
    from ..operators.stats import date_span

    return date_span(sessions, ["review_id"], "occurred_at").select("review_id", F.concat(F.lit("Context Pack "), "label").alias("title"))


def candidate_text(candidates: DataFrame, order: list[str]) -> DataFrame:
    """What an annotator reads of each review's candidates: a head line, then what each has, blank lines between."""
    some = lambda c, label: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(label), F.col(c))) if c in candidates.columns else F.lit(None).cast("string")
    head = F.concat(F.lit("["), "ref", F.lit("] type="), "type", F.lit(" support="), "support_type")
    nested = [some(c, f"{label}: ") for c, label in (("before", "before"), ("after", "after"), ("side_a", "sideA"), ("side_b", "sideB"), ("rationale", "rationale"), ("validation_idea", "validationIdea"))]
    text = F.concat_ws("\n", head, some("occurred_at", "occurredAt="), some("session_title", "session="), F.coalesce("text", F.lit("")), *nested)
    return candidates.groupBy("review_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, text.alias("_t")))), lambda x: x["_t"]), "\n\n").alias("candidate_text"))


def select(chosen: DataFrame, candidates: DataFrame) -> DataFrame:
    """The chosen candidates by section, in order: review_id, section, place, ref, type, text, and what the type has besides.

    chosen: review_id, pos, ref, over all of the annotator's lists; which list a ref stood in doesn't matter. Unknown refs and
    repeats are left out, the two constants always come first in the current state.
    """
    found = resolve_refs(chosen, candidates, ["review_id"]).where("valid").drop("valid")
    section, limit = F.lit(None).cast("string"), F.lit(0)
    for name, (types, n) in SECTIONS.items():
        section = F.when(F.col("type").isin(types), name).otherwise(section)
        limit = F.when(F.col("type").isin(types), n).otherwise(limit)
    rows = found.withColumns({"section": section, "limit": limit}).where("section IS NOT NULL")
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("review_id", "section").orderBy("pos"))).where("place <= limit").drop("limit", "pos")
    first = candidates.where(F.col("ref").isin(CONSTANTS)).withColumns({"section": F.lit("current_state"), "place": F.array_position(F.array(*map(F.lit, CONSTANTS)), F.col("ref")).cast("int") - 2})
    return rows.unionByName(first, allowMissingColumns=True)


def markdown(selected: DataFrame, questions: DataFrame, usage: str, project: str, purpose: str) -> DataFrame:
    """One text a review: usage notes, premises, the sections that have anything, and the question."""
    line = F.when(F.col("type") == "hypothesis", F.concat(F.lit("* 【仮説】"), "text")).when(F.col("section") == "cross_session_insights", F.concat(F.lit("* 【AIによる横断的な解釈】"), "text")).otherwise(F.concat(F.lit("* "), "text"))
    nested = [("before", "以前"), ("after", "現在"), ("side_a", "A"), ("side_b", "B"), ("rationale", "なぜそう考えられるか"), ("validation_idea", "検証案")]
    more = [F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"  * {label}："), F.col(c))) for c, label in nested if c in selected.columns]
    rows = selected.where(F.col("type") != "current_context").withColumn("line", F.concat_ws("\n", line, *more))
    title = F.element_at(F.create_map(*(F.lit(x) for kv in TITLES.items() for x in kv)), F.col("section"))
    number = F.array_position(F.array(*map(F.lit, TITLES)), F.col("section"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n")
    parts = rows.groupBy("review_id", "section").agg(body.alias("body")).select("review_id", number.alias("n"), F.concat(F.lit("\n\n## "), title, F.lit("\n\n"), "body").alias("part"))
    joined = parts.groupBy("review_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "part"))), lambda x: x["part"]), "").alias("sections"))
    head = f"# Context Pack｜{project}\n\n## このコンテキストの扱い\n\n{usage}\n\n## 現在の前提\n\n* プロジェクト名：{project}\n* 目的：{purpose}"
    q = F.trim(F.coalesce("question", F.lit("")))
    tail = F.when(q != "", F.concat(F.lit("\n\n## 今回相談したいこと\n\n"), q)).otherwise("")
    return questions.join(joined, "review_id", "left").select("review_id", F.concat(F.lit(head), F.coalesce("sections", F.lit("")), tail, F.lit("\n")).alias("markdown"))
