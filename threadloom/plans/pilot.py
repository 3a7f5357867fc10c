"""The concept pipeline as a whole: from messages and their annotation to concepts, findings and admission candidates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import findings, stats
from ..operators.units import evidence_units
from ..shared import kept
from . import admission, concepts


@dataclass
class Pilot:
    """units: the users' units; failures: sessions whose annotation is refused as a whole; outcomes: each action with its concept or
    reason; concepts, findings and candidates as their operators give them, with refs that are unique over all owners."""

    units: DataFrame
    failures: DataFrame
    outcomes: DataFrame
    concepts: DataFrame
    findings: DataFrame
    candidates: DataFrame


def last_units(units: DataFrame, keys: list[str]) -> DataFrame:
    """Units by ref; of equal refs the last in their order counts."""
    found = units.groupBy(*keys, "evidence_ref").agg(F.max_by(F.struct("unit_text", "message_id", "message_at"), F.struct("message_no", "unit_no", "unit_start")).alias("u"))
    return found.select(*keys, "evidence_ref", "u.*")


def actions(units: DataFrame, annotated: DataFrame, keys: list[str]) -> DataFrame:
    """The annotator's actions in order, each with why its surface form isn't in its unit or its unit can't have an occurrence."""
    rows = concepts.flatten_actions(annotated).withColumn("pos", F.struct("occurred_at", "session_id", "pos", "nth")).drop("nth", "disposition")
    rows = rows.join(last_units(units, keys), [*keys, "evidence_ref"], "left")
    idle = F.col("action").isin("skip", "uncertain")
    surface = F.when(idle, F.col("unit_text")).otherwise(F.col("surface_form"))  # idle actions have none to look for
    ground = concepts.grounding_reason(F.col("evidence_ref"), F.col("unit_text"), surface)
    at = concepts.concept_time(F.col("message_at"), F.col("occurred_at"))
    fixed = {"concept_id": F.lit("-"), "source_role": F.lit(concepts.SOURCE_ROLE), "source_type": F.lit(concepts.SOURCE_TYPE), "extraction_version": F.lit(concepts.EXTRACTION_VERSION)}
    rows = rows.withColumns({"ground_reason": ground, "thought_at": at})
    checked = rows.withColumns(fixed | {"day": F.col("occurred_at"), "occurred_at": F.col("thought_at")}).withColumn("occurrence_reason", concepts.occurrence_reason())
    return checked.select(*keys, "evidence_ref", F.col("day").alias("occurred_at"), "thought_at", "message_id", "pos", "action", "surface_form", "existing_ref", F.col("session_id").alias("batch_no"), "ground_reason", "occurrence_reason")


def run(messages: DataFrame, sessions: DataFrame, annotated: DataFrame, seeds: DataFrame | None = None) -> Pilot:
    """messages: owner, session_id, turn, role, content and optionally message_id and message_at; sessions: owner, session_id,
    occurred_at; annotated: owner, session_id, evidence_ref, pos, disposition, concepts; seeds: the owners' registries before. Sessions
    come in order of day and id. A session whose annotation doesn't cover its units fails alone."""
    keys = ["owner", "session_id"]
    more = {"message_id": F.concat_ws(":", *(F.col(k).cast("string") for k in [*keys, "turn"])), "message_at": F.lit(None).cast("string")}
    messages = messages.withColumns({c: v for c, v in more.items() if c not in messages.columns})
    units = evidence_units(messages, keys, ["turn"], roles=("user",)).withColumnRenamed("ref", "evidence_ref")
    failures = concepts.coverage(units.select(*keys, "evidence_ref"), annotated, keys)
    good = annotated.join(failures.select(*keys), keys, "left_anti").join(sessions.select(*keys, "occurred_at"), keys)
    outcomes = kept(concepts.resolve(actions(units, good, keys), ["owner"], seeds), "outcomes")

    name = lambda c: F.concat_ws(":", F.col("owner").cast("string"), c)
    entries = concepts.catalog(outcomes, ["owner"], seeds).withColumns({"ref": name("concept_ref"), "normalized_key": concepts.T.concept_key(F.col("canonical_label"))})
    accepted = outcomes.where("status = 'accepted'").withColumn("ref", name("concept_ref"))
    made = entries.join(stats.concept_stats(accepted, "ref"), "ref", "left").select(F.col("owner").alias("registry"), "ref", F.col("ref").alias("concept_id"), "canonical_label", "normalized_key", "aliases", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("occurrence_count", "distinct_session_count")))
    seen = accepted.select(F.col("ref").alias("concept_id"), "session_id", "evidence_ref")
    found = findings.of_concepts(made, seen).unionByName(findings.of_outcomes(accepted.select(F.col("ref").alias("concept_ref"), "surface_form", "canonical_label")))
    maybe = outcomes.where("status = 'provisional_match'")
    found = found.unionByName(findings.of_provisional(maybe.select(name("candidate_ref").alias("concept_ref"), "surface_form", F.col("existing_label").alias("canonical_label"), "evidence_ref")))
    found = found.unionByName(findings.of_sessions(seen, units.join(failures.select(*keys), keys, "left_anti").groupBy("session_id").agg(F.count("*").alias("user_unit_count"))))
    acts = accepted.select("pos", F.col("ref").alias("concept_ref"), "session_id", "evidence_ref", "surface_form", "resolved_as", "match_kind")
    texts = units.select("session_id", "evidence_ref", F.col("unit_text").alias("text"))
    return Pilot(units, failures, outcomes, made, found, admission.candidates(made.drop("registry", "occurrence_count", "distinct_session_count"), acts, found, sessions, texts))


def reasons(outcomes: DataFrame) -> DataFrame:
    """How many actions of each owner were refused for each reason, written reason or reason:detail."""
    return stats.reason_histogram(outcomes.where("status = 'rejected'"), ["owner"], "reason", "detail")


def token_totals(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Tokens over an annotator's calls. A missing figure counts as none, but if all are missing so is the sum."""
    return calls.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "total_tokens")))


def totals(pilot: Pilot, calls: DataFrame | None = None) -> DataFrame:
    """One row an owner: sessions that failed, units handled, outcomes of each kind, concepts and (of calls) tokens."""
    keys = ["owner"]
    handled = pilot.units.join(pilot.failures.select("owner", "session_id"), ["owner", "session_id"], "left_anti").groupBy(*keys).agg(F.count("*").alias("processed_units"))
    failed = pilot.failures.groupBy(*keys).agg(F.count("*").alias("failed_sessions"))
    out = pilot.units.select(*keys).distinct().join(handled, keys, "left").join(failed, keys, "left").join(concepts.metrics(pilot.outcomes, keys), keys, "left")
    out = out.select(*keys, *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in out.columns if c not in keys))
    return out if calls is None else out.join(token_totals(calls, keys), keys, "left")
