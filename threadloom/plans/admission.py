"""Admission of concepts: candidates from occurrences, and decisions by policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import shorten, squeeze, trim
from ..operators import ranking

#: Forms, the reasons of those always refused, and the admission rules of each policy in order: id, forms,
#: signals that must all be there, signals of which one must be.
ELIGIBLE = ["specific_named_concept", "stable_topic"]
HARD = {
    "pii": "hard_pii", "clause_or_statement": "hard_clause", "episodic_object": "hard_episodic", "temporary_state": "hard_temporary_state",
    "task_or_action": "hard_task_or_action", "relation_or_claim": "hard_relation_or_claim",
}
FORMS = [*ELIGIBLE, "generic_head", *list(HARD)[1:], "pii", "unclear"]
ROLES, POTENTIALS = ["central", "supporting", "incidental", "unclear"], ["high", "medium", "low"]
POLICIES = {
    "named_or_high": [("form_specific", ["specific_named_concept"], [], []), ("form_stable_high", ["stable_topic"], ["longitudinal_high"], [])],
    "topic_plus_signal": [("form_eligible_with_signal", ELIGIBLE, [], ["longitudinal_high", "evidence_central", "multi_session", "exact_recurrence"])],
    "high_only": [("form_eligible_high", ELIGIBLE, ["longitudinal_high"], [])],
}


def candidates(concepts: DataFrame, actions: DataFrame, findings: DataFrame, session_days: DataFrame, unit_texts: DataFrame) -> DataFrame:
    """One row a concept: its occurrences (each session and unit once, the first action's), sessions, days, flags, kinds of match and
    up to two units that represent it.

    concepts: ref, canonical_label, normalized_key; actions: pos, concept_ref, session_id, evidence_ref, surface_form,
    resolved_as, match_kind; findings: concept_ref, kind; session_days: session_id, occurred_at; unit_texts:
    session_id, evidence_ref, text.
    """
    own = actions.where(F.col("resolved_as").isin("new", "match")).withColumnRenamed("concept_ref", "ref")
    once = ranking.first_occurrence(own, ["ref", "session_id", "evidence_ref"], ["pos"])
    once = once.join(session_days.select("session_id", "occurred_at"), "session_id", "left").withColumn("occurred_at", F.coalesce("occurred_at", F.lit("")))
    order = ["occurred_at", "evidence_ref", "session_id"]
    kind = F.coalesce("match_kind", F.when(F.col("resolved_as") == "new", "new"))
    day = F.nullif("occurred_at", F.lit(""))
    sums = once.groupBy("ref").agg(
        F.count("*").alias("occurrence_count"), F.countDistinct("session_id").alias("distinct_session_count"), F.coalesce(F.min(day), F.lit("")).alias("first_seen_at"), F.coalesce(F.max(day), F.lit("")).alias("last_seen_at"),
        F.array_sort(F.collect_set("session_id")).alias("session_ids"), F.transform(F.array_sort(F.collect_list(F.struct(*order))), lambda x: x["evidence_ref"]).alias("evidence_refs"), F.array_sort(F.collect_set(kind)).alias("match_kinds"),
    )
    few = ranking.representatives(once, ["ref"], "session_id", order).join(unit_texts, ["session_id", "evidence_ref"], "left")
    text = shorten(F.coalesce("text", "surface_form"))
    shown = few.groupBy("ref").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "session_id", "evidence_ref", "occurred_at", text.alias("short_text")))), lambda x: x.dropFields("rank")).alias("representative_evidence"))
    flags = findings.groupBy(F.col("concept_ref").alias("ref")).agg(F.array_sort(F.collect_set("kind")).alias("suspicious_flags"))
    out = concepts.join(sums, "ref", "left").join(shown, "ref", "left").join(flags, "ref", "left")
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("occurrence_count", "distinct_session_count")}
    none = {c: F.coalesce(c, F.array().cast("array<string>")) for c in ("session_ids", "evidence_refs", "match_kinds", "suspicious_flags")}
    return out.withColumns(zero | none | {c: F.coalesce(c, F.lit("")) for c in ("first_seen_at", "last_seen_at")})


def provisional_hints(candidates_: DataFrame, actions: DataFrame, matches: DataFrame) -> DataFrame:
    """Other concepts that a candidate's surface forms were taken for, each once, in order: (ref, hints)."""
    own = actions.where(F.col("resolved_as").isin("new", "match")).select(F.col("concept_ref").alias("ref"), "surface_form").distinct()
    hit = own.join(matches, "surface_form").where("candidate_concept_ref <> ref")
    once = ranking.first_occurrence(hit, ["ref", "candidate_concept_ref", "surface_form", "evidence_ref"], ["pos"])
    hints = F.array_sort(F.collect_list(F.struct("pos", "candidate_concept_ref", "existing_canonical_label", "surface_form", "evidence_ref")))
    return candidates_.select("ref").join(once.groupBy("ref").agg(F.transform(hints, lambda h: h.dropFields("pos")).alias("hints")), "ref", "left")


def assessment_failures(candidates_: DataFrame, calls: DataFrame, assessments: DataFrame, keys: list[str] = ("batch_no",)) -> DataFrame:
    """The calls (keys and more columns) with reason and detail of the first failure in what each gave, in order of pos, else the first of
    its candidates, by their pos, that it left out; null if it has none.

    candidates_: keys, ref, pos; assessments: the columns of calls, candidate_ref, pos, concept_form, evidence_role,
    longitudinal_potential.
    """
    call = calls.columns
    known = candidates_.select(*keys, F.col("ref").alias("candidate_ref"), (F.col("pos") if "pos" in candidates_.columns else F.col("ref")).alias("place"))
    again = F.row_number().over(Window.partitionBy(*call, "candidate_ref").orderBy("pos")) > 1
    rows = assessments.withColumn("again", again).join(known.withColumn("known", F.lit(True)), [*keys, "candidate_ref"], "left")
    other = lambda c, values: ~F.coalesce(F.col(c).isin(values), F.lit(False))
    reason = F.when(F.col("known").isNull(), "unknown_candidate_ref").when(F.col("again"), "duplicate_candidate_ref").when(other("concept_form", FORMS), "invalid_concept_form").when(other("evidence_role", ROLES), "invalid_evidence_role").when(other("longitudinal_potential", POTENTIALS), "invalid_longitudinal_potential")
    bad = rows.withColumn("reason", reason).where("reason IS NOT NULL").groupBy(*call).agg(F.min_by(F.struct("reason", F.col("candidate_ref").alias("detail")), "pos").alias("bad"))
    gone = calls.join(known, list(keys)).join(assessments.select(*call, "candidate_ref"), [*call, "candidate_ref"], "left_anti")
    gone = gone.groupBy(*call).agg(F.struct(F.lit("missing_candidate_ref").alias("reason"), F.min_by("candidate_ref", "place").alias("detail")).alias("gone"))
    return calls.join(bad, call, "left").join(gone, call, "left").withColumn("f", F.coalesce("bad", "gone")).select(*call, "f.reason", "f.detail")


def assessment_failure(candidates_: DataFrame, assessments: DataFrame) -> DataFrame:
    """The first failure of the assessments, in order of pos, else the first missing ref, by the candidates' pos: (reason, detail), no
    row if there is none."""
    one = lambda df: df.withColumn("batch_no", F.lit(0))
    calls = candidates_.sparkSession.createDataFrame([(0,)], "batch_no int")
    return assessment_failures(one(candidates_), calls, one(assessments)).where("reason IS NOT NULL").select("reason", "detail")


def repairs(failures: DataFrame, most: int = 2) -> DataFrame:
    """The batches that go out once more, with the failure that the annotator is told: those whose last call failed, if they had fewer
    than `most`. failures: batch_no, attempt, reason, detail."""
    last = failures.groupBy("batch_no").agg(F.max_by(F.struct("attempt", "reason", "detail"), "attempt").alias("l")).select("batch_no", "l.*")
    return last.where(F.col("reason").isNotNull() & (F.col("attempt") < most)).select("batch_no", (F.col("attempt") + 1).alias("attempt"), "reason", "detail")


def settled(failures: DataFrame, assessments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The assessments that count, those of each batch's latest call without failure; and the batches that have none, with the
    last failure."""
    good = failures.groupBy("batch_no").agg(F.max(F.when(F.col("reason").isNull(), F.col("attempt"))).alias("good"), F.max_by(F.struct("attempt", "reason", "detail"), "attempt").alias("l"))
    counts = assessments.join(good.select("batch_no", F.col("good").alias("attempt")), ["batch_no", "attempt"], "left_semi")
    return counts, good.where("good IS NULL").select("batch_no", "l.attempt", "l.reason", "l.detail")


#: The reasons that each decision of the first admission version may have.
REASONS = {
    "admit": ["stable_topic", "specific_named_concept", "longitudinal_value"],
    "reject": ["generic", "clause", "episodic", "temporary_state", "task_or_action", "relation_or_claim", "pii"], "defer": ["insufficient_context"],
}


def admission_failure(candidates_: DataFrame, decisions: DataFrame) -> DataFrame:
    """As assessment_failure for decisions (candidate_ref, pos, decision, reason_code); of missing refs the first, by the
    candidates' pos, is told."""
    known = candidates_.select(F.col("ref").alias("candidate_ref"), F.col("pos").alias("place"))
    again = F.row_number().over(Window.partitionBy("candidate_ref").orderBy("pos")) > 1
    rows = decisions.withColumn("again", again).join(known, "candidate_ref", "left")
    allowed = F.lit(False)
    for d, reasons in REASONS.items():
        allowed = allowed | (F.col("decision") == d) & F.col("reason_code").isin(reasons)
    rules = {
        "unknown_candidate_ref": F.col("place").isNull(), "duplicate_candidate_ref": F.col("again"), "invalid_decision": ~F.col("decision").isin(list(REASONS)),
        "invalid_reason_code": ~F.col("reason_code").isin([r for rs in REASONS.values() for r in rs]), "invalid_decision_reason": ~allowed,
    }
    reason = F.coalesce(*(F.when(F.coalesce(c, F.lit(True)), k) for k, c in rules.items()))
    bad = rows.withColumn("reason", reason).where("reason IS NOT NULL").select("reason", F.col("candidate_ref").alias("detail"), F.lit(0).alias("later"), "pos")
    gone = known.join(decisions, "candidate_ref", "left_anti").select(F.lit("missing_candidate_ref").alias("reason"), F.col("candidate_ref").alias("detail"), F.lit(1).alias("later"), F.col("place").alias("pos"))
    return bad.unionByName(gone).orderBy("later", "pos").limit(1).select("reason", "detail")


def report_totals(judged: DataFrame, reasons: list[str] = [r for k in ("admit", "reject", "defer") for r in REASONS[k]]) -> DataFrame:
    """One row: candidates, those of each decision, and a count for each reason, also of those that never came."""
    d = F.col("decision")
    counts = {"admitted": d == "admit", "deferred": d == "defer", "rejected": ~d.isin("admit", "defer")} | {f"reason_{r}": F.col("reason_code") == r for r in reasons}
    return judged.agg(F.count("*").alias("total_candidates"), *(F.count_if(c).alias(n) for n, c in counts.items()))


def report_sessions(judged: DataFrame) -> DataFrame:
    """For each session the candidates that occur in it, by decision."""
    d = F.col("decision")
    rows = judged.select("decision", F.explode("session_ids").alias("session_id"))
    return rows.groupBy("session_id").agg(F.count("*").alias("candidate_count"), F.count_if(d == "admit").alias("admitted_count"), F.count_if(d == "defer").alias("deferred_count"), F.count_if(~d.isin("admit", "defer")).alias("rejected_count"))


def important_decisions(judged: DataFrame, labels: DataFrame) -> DataFrame:
    """labels (label) with the decision on each; of candidates that share a label the last (by pos) counts."""
    last = ranking.top_n(judged, ["canonical_label"], [F.desc("pos")], 1).select(F.col("canonical_label").alias("label"), "candidate_ref", "decision")
    return labels.join(last, "label", "left").withColumn("found", F.col("candidate_ref").isNotNull())


def resolved_evidence(candidates_: DataFrame, unit_texts: DataFrame) -> DataFrame:
    """Candidates with only that representative evidence whose unit has a text, shortened, and whether any is left."""
    flat = candidates_.select("ref", F.posexplode("representative_evidence").alias("n", "e")).select("ref", "n", "e", F.col("e.session_id").alias("session_id"), F.col("e.evidence_ref").alias("evidence_ref"))
    found = flat.join(unit_texts, ["session_id", "evidence_ref"]).where(F.length(trim(F.col("text"))) > 0)
    kind = candidates_.schema["representative_evidence"].dataType.simpleString()
    kept = found.groupBy("ref").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", F.col("e").withField("short_text", shorten(F.col("text"))).alias("e")))), lambda x: x["e"]).alias("_kept"))
    out = candidates_.join(kept, "ref", "left").withColumn("representative_evidence", F.coalesce("_kept", F.array().cast(kind)))
    return out.drop("_kept").withColumn("evidence_resolved", F.size("representative_evidence") > 0)


def evidence_integrity(resolved: DataFrame) -> DataFrame:
    """One row: candidates, those with evidence, those without."""
    return resolved.agg(F.count("*").alias("total_candidates"), F.count_if("evidence_resolved").alias("resolved_candidates"), F.count_if(~F.col("evidence_resolved")).alias("unresolved_candidates"))


def signals(form: Column, role: Column, potential: Column, sessions: Column, kinds: Column) -> Column:
    found = {
        "specific_named_concept": form == "specific_named_concept", "stable_topic": form == "stable_topic", "longitudinal_high": potential == "high", "evidence_central": role == "central",
        "multi_session": sessions >= 2, "exact_recurrence": F.array_contains(kinds, "exact"), "observed_alias_recurrence": F.array_contains(kinds, "observed_alias"),
    }
    return F.filter(F.array(*(F.when(c, k) for k, c in found.items())), lambda x: x.isNotNull())


def decide(rows: DataFrame, policy: str) -> DataFrame:
    """Adds decision, rule and reason to candidates joined with their assessment (concept_form, evidence_role,
    longitudinal_potential, distinct_session_count, match_kinds)."""
    form = F.col("concept_form")
    active = signals(form, F.col("evidence_role"), F.col("longitudinal_potential"), F.col("distinct_session_count"), F.col("match_kinds"))
    verdict = lambda d, rule, why: F.struct(F.lit(d).alias("decision"), (F.lit(rule) if isinstance(rule, str) else rule).alias("policy_rule"), F.lit(why).alias("reason_code"))
    out = F.when(form == "generic_head", verdict("reject", "hard_generic", "hard_generic")).when(form == "unclear", verdict("defer", "form_unclear", "form_unclear"))
    for name, why in HARD.items():
        out = out.when(form == name, verdict("reject", f"hard_negative:{name}", why))
    for rule, forms, need, any_ in POLICIES[policy]:
        fits = form.isin(forms)
        if need:
            fits = fits & (F.size(F.array_except(F.array(*map(F.lit, need)), active)) == 0)
        if any_:
            fits = fits & F.arrays_overlap(F.array(*map(F.lit, any_)), active)
        out = out.when(fits, verdict("admit", rule, rule))
    out = out.when(form.isin(ELIGIBLE), verdict("defer", "eligible_without_signal", "insufficient_positive_signal"))
    out = out.otherwise(verdict("reject", "default", "insufficient_positive_signal"))
    return rows.select("*", out.alias("_v")).select(*rows.columns, "_v.*")


def duplicate_refs(candidates_: DataFrame) -> DataFrame:
    """Candidate refs that come more than once; there should be none."""
    return candidates_.groupBy("ref").count().where("count > 1").select("ref", F.lit("duplicate_candidate_ref").alias("reason"))


def report_lists(judged: DataFrame) -> DataFrame:
    """The refs of each decision, in order."""
    return judged.groupBy("decision").agg(F.array_sort(F.collect_list("candidate_ref")).alias("refs"))


def report_rows(judged: DataFrame) -> DataFrame:
    """The same as rows: decision, place (from 1) and candidate_ref, so that a decision of any number of candidates is no one value."""
    return ranking.numbered(judged.select("decision", "candidate_ref"), [F.asc("candidate_ref")], ["decision"])


def shares(judged: DataFrame) -> DataFrame:
    """The first version's figures: shares of A and B, and of C and D, among labelled admissions; admitted A; rejected D. Null without cases."""
    d, k, n = F.col("decision"), F.col("class"), F.count_if
    out = judged.agg(n((d == "admit") & k.isin("A", "B")).alias("ab"), n((d == "admit") & k.isin("C", "D")).alias("cd"), n(k == "A").alias("a"), n((k == "A") & (d == "admit")).alias("aa"), n(k == "D").alias("dd"), n((k == "D") & (d == "reject")).alias("dr"))
    r = lambda x, y: F.when(y > 0, x / y)
    c = F.col
    return out.select(r(c("ab"), c("ab") + c("cd")).alias("admitted_ab_share"), r(c("cd"), c("ab") + c("cd")).alias("admitted_cd_share"), r(c("aa"), c("a")).alias("class_a_admit_rate"), r(c("dr"), c("dd")).alias("class_d_reject_rate"))


NONE = "（なし）"


def candidate_lines(candidates_: DataFrame) -> DataFrame:
    """What an annotator of admissions reads of each candidate: (ref, text)."""
    some = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(NONE))
    listed = lambda c: F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise(NONE)
    shown = F.transform("representative_evidence", lambda e: F.concat(F.lit("- ["), e["session_id"], F.lit("]["), e["evidence_ref"], F.lit("] "), e["short_text"]))
    evidence = F.when(F.size(F.coalesce("representative_evidence", F.array().cast(candidates_.schema["representative_evidence"].dataType))) > 0, F.array_join(shown, "\n")).otherwise("- " + NONE)
    label = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    lines = [
        F.concat(F.lit("## "), "ref"), label("canonicalLabel", F.col("canonical_label")), label("occurrenceCount", F.col("occurrence_count").cast("string")), label("distinctSessionCount", F.col("distinct_session_count").cast("string")),
        label("firstSeenAt", some("first_seen_at")), label("lastSeenAt", some("last_seen_at")), label("sessionIds", listed("session_ids")), label("suspiciousFlags", listed("suspicious_flags")), F.lit("representativeEvidence:"), evidence,
    ]
    return candidates_.select("ref", F.concat_ws("\n", *lines).alias("text"))


def assessment_lines(candidates_: DataFrame, unit_texts: DataFrame) -> DataFrame:
    """What an annotator of assessments reads of each candidate: its label and the whole units that represent it, lettered."""
    flat = candidates_.select("ref", F.posexplode("representative_evidence").alias("n", "e")).select("ref", "n", "e.session_id", "e.evidence_ref")
    found = flat.join(unit_texts, ["session_id", "evidence_ref"]).withColumn("text", squeeze(F.col("text"))).where("text <> ''")
    nth = F.row_number().over(Window.partitionBy("ref").orderBy("n"))
    lettered = found.withColumn("nth", nth).withColumn("line", F.concat(F.lit("Evidence "), F.char(F.lit(64) + F.col("nth")), F.lit(":\n"), "text"))
    shown = lettered.groupBy("ref").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "line"))), lambda x: x["line"]), "\n\n").alias("evidence"))
    out = candidates_.select("ref", "canonical_label").join(shown, "ref", "left")
    return out.select("ref", F.concat(F.lit("## "), "ref", F.lit("\ncanonicalLabel: "), "canonical_label", F.lit("\nrepresentativeEvidence:\n"), F.coalesce("evidence", F.lit("- " + NONE))).alias("text"))


def batches(candidates_: DataFrame, seed: str, target: int = 6) -> DataFrame:
    """Candidates with the batch in which an annotator assesses them."""
    return ranking.batches_over_all(candidates_, "ref", seed, target)


def reassemble(candidates_: DataFrame, assessments: DataFrame) -> DataFrame:
    """The assessments of all batches joined to their candidates, whose order (pos) stays; only after assessment_failure found none."""
    return candidates_.join(assessments.withColumnRenamed("candidate_ref", "ref").drop("pos"), "ref")


def merge_usage(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Token figures, the later ones where they are known."""
    names = ["input_tokens", "output_tokens", "total_tokens"]
    return before.join(after.select(key, *(F.col(n).alias(f"_{n}") for n in names)), key, "left").select(key, *(F.coalesce(f"_{n}", n).alias(n) for n in names))


def admit(candidates_: DataFrame, unit_texts: DataFrame, decisions: DataFrame) -> dict[str, DataFrame]:
    """The admission pilot: candidates with evidence that is there, joined with an annotator's decisions, and its report. Check failures first:
    duplicate_refs, evidence_integrity (none may be unresolved) and admission_failure."""
    resolved = resolved_evidence(candidates_, unit_texts)
    judged = resolved.withColumnRenamed("ref", "candidate_ref").join(decisions.select("candidate_ref", "decision", "reason_code"), "candidate_ref")
    return {"integrity": evidence_integrity(resolved), "judged": judged, "totals": report_totals(judged), "lists": report_lists(judged), "sessions": report_sessions(judged)}


def assess(candidates_: DataFrame, unit_texts: DataFrame, assessments: DataFrame, policy: str) -> dict[str, DataFrame]:
    """The assessment pilot: as admit, with decisions by a policy on an annotator's assessments."""
    resolved = resolved_evidence(candidates_, unit_texts)
    judged = decide(reassemble(resolved, assessments), policy).withColumnRenamed("ref", "candidate_ref")
    return {"integrity": evidence_integrity(resolved), "judged": judged, "totals": report_totals(judged), "lists": report_lists(judged), "sessions": report_sessions(judged)}
