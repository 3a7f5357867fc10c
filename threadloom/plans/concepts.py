"""Concepts: from an annotator's actions to a registry of identities, with reasons for what is refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T
from ..operators import ranking
from ..operators.units import parse_ref
from ..shared import kept

#: Fixed values.
PER_UNIT, EXTRACTION_VERSION, SOURCE_ROLE, SOURCE_TYPE = 3, "concept-extract-v1", "user", "evidence_unit"
OCCURRENCE_KEY = ["extraction_version", "source_type", "message_id", "evidence_ref", "concept_id"]


def flatten_actions(units: DataFrame) -> DataFrame:
    """Annotated units (keys, evidence_ref, pos, disposition, concepts array<struct<action, surface_form, existing_ref>>)
    to actions in order; units that were skipped or uncertain give one action of that name."""
    rows = units.select("*", F.posexplode_outer("concepts").alias("nth", "c"))
    kept_ = F.when(F.col("disposition") == "extracted", F.col("c.action")).otherwise(F.col("disposition"))
    return rows.withColumns({"action": kept_, "surface_form": F.coalesce("c.surface_form", F.lit("")), "existing_ref": F.col("c.existing_ref")}).where("action IS NOT NULL").drop("c", "concepts")


def coverage(expected: DataFrame, units: DataFrame, keys: list[str]) -> DataFrame:
    """The first failure of each batch, in order of its units: unknown or duplicate ref, wrong number of concepts; else refs that
    are missing. No row: all is covered."""
    n = F.coalesce(F.size("concepts"), F.lit(0))
    rows = units.join(expected.select(*keys, "evidence_ref").distinct().withColumn("known", F.lit(True)), [*keys, "evidence_ref"], "left")
    again = F.row_number().over(Window.partitionBy(*keys, "evidence_ref").orderBy("pos")) > 1
    rows = rows.withColumn("again", again)
    reason = F.when(F.col("known").isNull(), "unknown_evidence_ref").when(F.col("again"), "duplicate_evidence_ref").when((F.col("disposition") == "extracted") & ~n.between(1, PER_UNIT), "extracted_concept_count").when((F.col("disposition") == "skip") & (n > 0), "skip_with_concepts").when((F.col("disposition") == "uncertain") & (n > 0), "uncertain_with_concepts")
    bad = rows.withColumn("reason", reason).where("reason IS NOT NULL").groupBy(*keys).agg(F.min_by(F.struct("reason", F.col("evidence_ref").alias("detail")), "pos").alias("f")).select(*keys, "f.*")
    gone = expected.join(units.select(*keys, "evidence_ref"), [*keys, "evidence_ref"], "left_anti").join(bad.select(*keys), keys, "left_anti")
    gone = gone.groupBy(*keys).agg(F.lit("missing_unit").alias("reason"), F.array_join(F.array_sort(F.collect_list("evidence_ref")), ",").alias("detail"))
    return bad.unionByName(gone)


def grounding_reason(ref: Column, unit_text: Column, surface: Column) -> Column:
    """Why a surface form isn't grounded in its unit; null if it is."""
    return F.when(parse_ref(ref).isNull(), "invalid_evidence_ref").when(unit_text.isNull(), "ref_not_in_batch").when(T.trim(F.coalesce(surface, F.lit(""))) == "", "empty_surface").when(~T.quote_found(T.quote_text(unit_text), T.quote_text(surface)), "surface_not_in_unit")


def occurrence_reason() -> Column:
    """Why an occurrence is not valid, by its columns; null if it is."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for c in ("concept_id", "session_id", "message_id", "occurred_at"):
        out = out.when(F.trim(F.coalesce(c, F.lit(""))) == "", f"missing_{c}")
    out = out.when(parse_ref(F.col("evidence_ref")).isNull(), "invalid_evidence_ref").when(F.col("source_role") != SOURCE_ROLE, "non_user_source_role")
    return out.when(F.col("source_type") != SOURCE_TYPE, "unsupported_source_type").when(F.col("extraction_version") != EXTRACTION_VERSION, "unsupported_extraction_version")


def concept_time(message_at: Column, session_day: Column) -> Column:
    """When a concept was thought of: the message's own time, else the session's day."""
    return F.coalesce(F.nullif(T.trim(message_at), F.lit("")), session_day)


def unique_aliases(rows: DataFrame, concept: str, canonical: str, alias: str, order: str) -> DataFrame:
    """(concept, place, alias) of the aliases whose key isn't the concept's own nor that of an earlier alias, in order."""
    label = T.concept_label(F.col(alias))
    keyed = rows.select(concept, order, label.alias("alias"), T.concept_key(F.col(canonical)).alias("own")).withColumn("key", T.concept_key(F.col("alias"), True))
    once = ranking.first_occurrence(keyed.where("key <> '' AND key <> own"), [concept, "key"], [order])
    return once.withColumn("place", F.row_number().over(Window.partitionBy(concept).orderBy(order))).select(concept, "place", "alias")


_SEEDS = "concept_ref string, concept_id string, canonical_label string, aliases array<string>"


def _catalog(seeds: DataFrame, registry: list[str]) -> tuple[DataFrame, DataFrame]:
    """(registry, key, seed) of the concepts' own keys, and of the aliases that only one concept has."""
    entry = F.struct("concept_id", "concept_ref", "canonical_label")
    own = seeds.select(*registry, T.concept_key(F.col("canonical_label")).alias("key"), entry.alias("seed"))
    alias = seeds.select(*registry, entry.alias("seed"), F.explode("aliases").alias("alias")).withColumn("key", T.concept_key(F.col("alias"))).where("key <> ''")
    alias = alias.groupBy(*registry, "key").agg(F.min("seed").alias("alias_seed"), F.max("seed").alias("other")).where("alias_seed = other").drop("other")
    return own, alias


def resolve(actions: DataFrame, registry: list[str], seeds: DataFrame | None = None, batch: str = "batch_no", trace: list | None = None) -> DataFrame:
    """Resolves an annotator's actions, in order of `pos` within each registry, to concepts: one outcome an action, and one more for
    each provisional match.

    actions: registry columns, batch, pos, session_id, evidence_ref, action (match, new, skip, uncertain), surface_form, existing_ref,
    ground_reason (why the surface form isn't in its unit, null if it is) and optionally occurrence_reason; seeds: the registry as it
    was before (registry columns, concept_ref C01.., concept_id, canonical_label, aliases), empty if not given.

    A surface form is a concept's when it has its key, or an alias that only this concept has. Other "match" actions must name a concept
    that is there at that point; they are noted as provisional and go on as "new", and never merge. A new concept's id is its key, its ref
    the next number. A unit has three concepts at most, each once. Adds status, resolved_as, match_kind, concept_id, concept_ref,
    canonical_label, candidate_ref, existing_label, reason and detail.

    Only a match that no seed serves depends on what earlier actions made: on its key, and on the concept that has its ref. Units without
    such a match are decided once. The others are decided by change: each round tells which keys and refs came to be made at another
    place, and only units that hold one of them are decided again, until none is. `trace` gets the number of actions decided in each round.
    """
    null = F.lit(None).cast("string")
    spark = actions.sparkSession
    if seeds is None:
        seeds = spark.createDataFrame([], StructType(actions.select(*registry).schema.fields + StructType.fromDDL(_SEEDS).fields))
    label = T.concept_label(F.col("surface_form"))
    rows = actions if "occurrence_reason" in actions.columns else actions.withColumn("occurrence_reason", null)
    rows = rows.withColumn("label", label).withColumns({"key": T.concept_key(F.col("label"), True), "_bad": T.candidate_reason(F.col("label"))})
    refused = F.when(F.col("_bad").isNotNull(), F.struct(F.lit("invalid_candidate").alias("reason"), F.col("_bad").alias("detail"))).when(T.has_honorific(F.col("label")), F.struct(F.lit("honorific_person").alias("reason"), null.alias("detail")))
    own, alias = _catalog(seeds, registry)
    fixed = seeds.groupBy(*registry).agg(F.count("*").alias("_seeds"))
    by_ref = seeds.select(*registry, F.col("concept_ref").alias("existing_ref"), F.col("canonical_label").alias("_seed_label"))
    rows = rows.withColumn("refused", refused).join(own, [*registry, "key"], "left").join(alias, [*registry, "key"], "left").join(fixed, registry, "left").join(by_ref, [*registry, "existing_ref"], "left")
    rows = rows.withColumns({"_seeds": F.coalesce("_seeds", F.lit(0)), "known": F.coalesce("seed", "alias_seed")})
    is_match = F.col("action") == "match"
    unit = [*registry, "session_id", "evidence_ref"]
    acted = F.col("action").isin("match", "new") & F.col("ground_reason").isNull()
    # a unit is open if what it gives may depend on other units; its rows are windows of their own below anyway
    waits = acted & is_match & F.col("known").isNull()
    rows = kept(rows.drop("_bad", "alias_seed").withColumn("open", F.max(waits.cast("int")).over(Window.partitionBy(*unit)) == 1), "actions")
    acts = rows.where(acted)

    def decided(some: DataFrame) -> DataFrame:
        """Actions (with served and there) with why they are refused, or their concept and whether their unit takes it."""
        lost = is_match & ~F.col("served") & ~F.col("there")
        why = F.when(lost, F.struct(F.lit("unknown_concept_ref").alias("reason"), F.col("existing_ref").alias("detail"))).when(~(is_match & F.col("served")), F.col("refused"))
        why = F.coalesce(why, F.when(F.col("occurrence_reason").isNotNull(), F.struct(F.lit("invalid_occurrence").alias("reason"), F.col("occurrence_reason").alias("detail"))))
        some = some.withColumns({"why": why, "provisional": is_match & ~F.col("served") & F.col("there"), "concept": F.coalesce("known.concept_id", F.concat(F.lit("virtual:"), F.col("key")))})
        fit = ranking.first_distinct(some.where("why IS NULL"), unit, "concept", ["pos"], PER_UNIT).drop("slot")
        return fit.unionByName(some.where("why IS NOT NULL").withColumn("reason", null))

    def first_made(fit: DataFrame, more: list[str] = ()) -> DataFrame:
        return fit.groupBy(*registry, *more, "key", "_seeds").agg(F.min("pos").alias("first_pos"), F.min_by(batch, "pos").alias("first_batch"), F.min_by("label", "pos").alias("made_label"))

    makes = F.col("why").isNull() & F.col("reason").isNull() & F.col("known").isNull()
    seeded = {"served": F.col("known").isNotNull(), "there": F.col("_seed_label").isNotNull()}
    closed = kept(decided(acts.where("NOT open").withColumns(seeded)), "fit")
    base = kept(first_made(closed.where(makes)), "made")
    open_ = acts.where("open")
    if trace is not None:
        trace.append(acts.count())
    waiting_some = open_.limit(1).count() > 0
    # of each open unit, as if all refs were there; and the refs that open units ask for
    given = first_made(decided(open_.withColumns({"served": F.col("known").isNotNull(), "there": F.col("existing_ref").isNotNull()})).where(makes), ["session_id", "evidence_ref"])
    asked = open_.where(is_match & F.col("existing_ref").isNotNull()).select(*registry, "existing_ref").distinct()
    none = lambda df: spark.createDataFrame([], df.schema)
    given, asked = (kept(given, "made"), kept(asked, "asked")) if waiting_some else (none(given), none(asked))

    def places(given: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(registry, key, ...) of the concepts that are made, with their number; and those that open units ask for by ref."""
        all_ = base.select(*registry, "key", "_seeds", "first_pos", "first_batch", "made_label").unionByName(given.drop("session_id", "evidence_ref"))
        all_ = all_.groupBy(*registry, "key", "_seeds").agg(F.min("first_pos").alias("first_pos"), F.min_by("first_batch", "first_pos").alias("first_batch"), F.min_by("made_label", "first_pos").alias("made_label"))
        made = ranking.numbered(all_, [F.asc("first_pos"), F.asc("key")], registry, "n").withColumn("n", F.col("n") + F.col("_seeds")).drop("_seeds")
        made = kept(made.withColumn("ref", F.format_string("C%02d", "n")), "made")
        refs = made.select(*registry, F.col("ref").alias("existing_ref"), F.col("first_pos").alias("_ref_pos"), F.col("made_label").alias("_ref_label")).join(asked, [*registry, "existing_ref"])
        return made, kept(refs, "refs") if waiting_some else none(refs)

    def with_state(some: DataFrame, made: DataFrame, refs: DataFrame) -> DataFrame:
        some = some.join(made.drop("ref"), [*registry, "key"], "left").join(refs, [*registry, "existing_ref"], "left")
        before = lambda c: F.coalesce(F.col(c) < F.col("pos"), F.lit(False))
        return some.withColumns({"served": F.col("known").isNotNull() | before("first_pos"), "there": F.col("_seed_label").isNotNull() | before("_ref_pos")})

    made, refs = places(given)
    changed = open_.select(*unit).distinct()  # all that are open were decided without places
    while waiting_some:
        again = kept(decided(with_state(open_.join(changed, unit, "left_semi"), made, refs)), "fit")
        n = again.count()
        if not n:
            break
        if trace is not None:
            trace.append(n)
        now = first_made(again.where(makes), ["session_id", "evidence_ref"])
        given = kept(given.join(again.select(*unit).distinct(), unit, "left_anti").unionByName(now), "made")
        was_made, was_refs = made, refs
        made, refs = places(given)
        moved = lambda new, old, on: new.join(old, on, "left_anti").unionByName(old.join(new, on, "left_anti")).select(*on[:-1]).distinct()
        keys = moved(made.select(*registry, "key", "first_pos"), was_made.select(*registry, "key", "first_pos"), [*registry, "key", "first_pos"])
        names = moved(refs.select(*registry, "existing_ref", "_ref_pos"), was_refs.select(*registry, "existing_ref", "_ref_pos"), [*registry, "existing_ref", "_ref_pos"])
        waiting = open_.where(is_match)
        changed = kept(waiting.join(keys, [*registry, "key"], "left_semi").select(*unit).unionByName(waiting.join(names, [*registry, "existing_ref"], "left_semi").select(*unit)).distinct(), "changed")

    # all that was decided last, with the concepts as they are in the end
    fit = closed.join(made.drop("ref"), [*registry, "key"], "left").join(refs, [*registry, "existing_ref"], "left")
    fit = fit.unionByName(decided(with_state(open_, made, refs))) if waiting_some else fit
    exact = F.col("seed").isNotNull() | F.coalesce(F.col("first_pos") < F.col("pos"), F.lit(False))
    fit = kept(fit.withColumn("exact", exact), "fit")
    now, fit = fit, fit.where("why IS NULL")

    names = {"duplicate": "duplicate_concept_in_unit", "over_limit": "max_concepts_per_unit"}
    ok = F.col("reason").isNull()
    fit = fit.replace(names, subset=["reason"])
    created = F.col("known").isNull()
    fresh = created & (F.col(batch) == F.coalesce("first_batch", batch))
    accepted = fit.select(
        *actions.columns, "key", F.when(ok, "accepted").otherwise("rejected").alias("status"), F.when(ok, F.when(fresh, "new").otherwise("match")).alias("resolved_as"),
        F.when(ok, F.when(F.col("exact"), "exact").when(~created, "observed_alias").when(F.col("provisional"), "semantic")).alias("match_kind"), F.when(ok, F.col("concept")).alias("concept_id"),
        F.when(ok, F.coalesce("known.concept_ref", F.format_string("C%02d", "n"))).alias("concept_ref"), F.when(ok, F.coalesce("known.canonical_label", "made_label", "label")).alias("canonical_label"), null.alias("candidate_ref"), null.alias("existing_label"), "reason", null.alias("detail"),
    )
    blank = {c: null for c in ("resolved_as", "match_kind", "concept_id", "concept_ref", "canonical_label", "candidate_ref", "existing_label", "reason", "detail")}
    plain = lambda df, status, **more: df.select(*actions.columns, "key", status.alias("status"), *((more.get(c, v)).alias(c) for c, v in blank.items()))
    bad = plain(now.where("why IS NOT NULL"), F.lit("rejected"), reason=F.col("why.reason"), detail=F.col("why.detail"))
    idle = F.col("action").isin("skip", "uncertain")
    left = plain(rows.where(idle | F.col("ground_reason").isNotNull()), F.when(F.col("ground_reason").isNull(), F.col("action")).otherwise("rejected"), reason=F.col("ground_reason"))
    maybe = plain(now.where("provisional"), F.lit("provisional_match"), match_kind=F.lit("semantic"), candidate_ref=F.col("existing_ref"), existing_label=F.coalesce("_seed_label", "_ref_label"))
    return accepted.unionByName(bad).unionByName(left).unionByName(maybe)


def catalog(outcomes: DataFrame, registry: list[str], seeds: DataFrame | None = None) -> DataFrame:
    """The registry after the outcomes: the seeds, then each concept that they made, with its aliases."""
    made = outcomes.where("status = 'accepted' AND concept_id LIKE 'virtual:%'").groupBy(*registry, "concept_ref", "concept_id").agg(F.min("canonical_label").alias("canonical_label"))
    made = made.withColumn("aliases", F.array().cast("array<string>"))
    return made if seeds is None else seeds.unionByName(made.join(seeds.select(*registry, "concept_ref"), [*registry, "concept_ref"], "left_anti"))


def metrics(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """Outcomes of each kind: occurrences that match, concepts made, skips, uncertain ones, rejections, occurrences, concepts met and
    provisional matches."""
    s, n = F.col("status"), F.count_if
    fresh = F.when((s == "accepted") & (F.col("resolved_as") == "new"), F.col("concept_id"))
    return outcomes.groupBy(*keys).agg(
        n((s == "accepted") & (F.col("resolved_as") == "match")).alias("match"), F.countDistinct(fresh).alias("new"), n(s == "skip").alias("skip"), n(s == "uncertain").alias("uncertain"), n(s == "rejected").alias("rejected"),
        n(s == "accepted").alias("occurrences"), F.countDistinct(F.when(s == "accepted", F.col("concept_id"))).alias("unique_concepts"), n(s == "provisional_match").alias("provisional_match"),
    )


def catalog_text(entries: DataFrame, keys: list[str]) -> DataFrame:
    """What an annotator reads of a registry: a line `ref | label | aliases: a, b` for each concept, in order."""
    line = F.concat_ws(" | ", "concept_ref", "canonical_label", F.when(F.size("aliases") > 0, F.concat(F.lit("aliases: "), F.array_join("aliases", ", "))))
    number = F.regexp_extract("concept_ref", r"(\d+)", 1).cast("int")
    return entries.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(number.alias("n"), line.alias("line")))), lambda x: x["line"]), "\n").alias("catalog_text"))
