"""Findings about concepts that a person should look at: (kind, concept_ref, other_ref, label, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .joins import key_containment
from .stats import over_extraction



def _rows(rows: DataFrame, kinds: dict[str, Column], ref: str, label: Column, detail: Column | None = None) -> DataFrame:
    """A row for each kind whose rule holds."""
    found = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), k) for k, c in kinds.items())), lambda k: k.isNotNull())
    null = F.lit(None).cast("string")
    return rows.select(F.explode(found).alias("kind"), F.col(ref).alias("concept_ref"), null.alias("other_ref"), label.alias("label"), (detail if detail is not None else null).alias("detail"))


def of_concepts(concepts: DataFrame, occurrences: DataFrame) -> DataFrame:
    """concepts: ref, concept_id, canonical_label, normalized_key, aliases and optionally registry, within which concepts are compared;
    occurrences: concept_id, session_id, evidence_ref."""
    within = [c for c in ("registry",) if c in concepts.columns]
    units = occurrences.groupBy("concept_id").agg(F.countDistinct("session_id", "evidence_ref").alias("n_units"))
    c = concepts.join(units, "concept_id", "left")
    x = F.col("canonical_label")
    own = _rows(
        c,
        {
            "long_label": F.length(x) > T.LONG_LABEL, "honorific_person": T.is_honorific(x), "generic_deny": T.is_denied(x), "episodic_phrase": T.is_episodic(x), "generic_surface": T.is_generic_surface(x),
            "adjective_only": T.is_adjective(x), "clause_like": T.is_clause_like(x), "singleton_new": F.coalesce("n_units", F.lit(0)) <= 1,
        },
        "ref", x,
    )
    a = concepts.select(*within, "ref", F.explode("aliases").alias("alias"))
    of_alias = _rows(a, {"alias_honorific_person": T.has_honorific(F.col("alias")), "alias_long_clause": T.is_long_clause(F.col("alias")), "episodic_phrase": T.is_episodic(F.col("alias"))}, "ref", F.col("alias"))
    null = F.lit(None).cast("string")
    keys = concepts.select(*within, "ref", "canonical_label", "normalized_key")
    pairs = key_containment(keys, "ref", "normalized_key", within).select(F.least("inner_id", "outer_id").alias("a"), F.greatest("inner_id", "outer_id").alias("b")).distinct()
    name = lambda side: keys.select(F.col("ref").alias(side), F.col("canonical_label").alias(f"{side}_label"))
    contained = pairs.join(name("a"), "a").join(name("b"), "b").select(F.lit("normalized_key_containment").alias("kind"), F.col("a").alias("concept_ref"), F.col("b").alias("other_ref"), F.concat_ws(" / ", "a_label", "b_label").alias("label"), null.alias("detail"))
    keyed = a.withColumn("key", T.concept_key(F.col("alias")))
    clash = keyed.join(concepts.select(*within, F.col("ref").alias("other_ref"), F.col("normalized_key").alias("key")), [*within, "key"]).where("ref <> other_ref")
    clash = clash.select(F.lit("alias_canonical_collision").alias("kind"), F.col("ref").alias("concept_ref"), "other_ref", F.col("alias").alias("label"), null.alias("detail"))
    return own.unionByName(of_alias).unionByName(contained).unionByName(clash)


def of_outcomes(outcomes: DataFrame) -> DataFrame:
    """Accepted outcomes: concept_ref, surface_form, canonical_label."""
    s, c = F.col("surface_form"), F.col("canonical_label")
    return _rows(outcomes.where((s != "") & (c != "")), {"canonical_surface_divergence": T.is_divergent(s, c), "canonical_over_generalized": T.is_over_general(s, c)}, "concept_ref", F.concat(s, F.lit(" → "), c))


def of_provisional(matches: DataFrame) -> DataFrame:
    """Provisional matches: concept_ref, surface_form, canonical_label, evidence_ref."""
    s, c = F.col("surface_form"), F.col("canonical_label")
    same = T.concept_key(s, True) == T.concept_key(c, True)
    kinds = {
        "semantic_provisional_match": F.lit(True), "semantic_lexical_gap": T.is_divergent(s, c), "broad_surface_specific_canonical": T.is_broad(s) & ~same,
        "surface_canonical_grain_mismatch": T.is_over_general(c, s) | T.is_over_general(s, c),
    }
    return _rows(matches, kinds, "concept_ref", F.concat(s, F.lit(" → "), c), F.col("evidence_ref"))


def of_sessions(occurrences: DataFrame, units: DataFrame) -> DataFrame:
    """units: session_id, user_unit_count."""
    n = occurrences.groupBy("session_id").agg(F.countDistinct("concept_id").alias("n"))
    rows = units.join(n, "session_id", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("none", F.lit(None).cast("string"))
    detail = F.concat(F.lit("unique="), F.col("n").cast("string"), F.lit("/units="), F.col("user_unit_count").cast("string"))
    return _rows(rows, {"session_over_extraction": over_extraction(F.col("n"), F.col("user_unit_count"))}, "none", F.col("session_id"), detail)
