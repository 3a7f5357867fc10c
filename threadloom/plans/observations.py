"""Reviews to observations: projection without repeats, and what a home page shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from ..functions import labels as L
from ..functions.dates import thought_date
from ..operators import joins, ranking
from ..shared import kept
from ..sources.payloads import parse_strict

#: Versions that project, the version of the projection, and the kinds.
PROJECTABLE, PROJECTION_VERSION = ["integrated-review-v5"], "review-observation-v1"
SECTIONS = {"shifts": ("shift", "shift"), "cross_insights": ("connection", "insight"), "tensions": ("tension", "tension")}
PER_KIND = 5


def visible(item: Column) -> Column:
    """Only an explicit false hides."""
    return F.coalesce(item["semantic_valid"], F.lit(True))


def eligibility(reviews: DataFrame, version: str = "prompt_version") -> DataFrame:
    """Adds skip_reason, null where the review projects."""
    return reviews.withColumn("skip_reason", F.when(F.col(version).isin(PROJECTABLE), None).otherwise("unsupported_prompt_version"))


def _evidence(item: Column, section: str) -> Column:
    none = F.array().cast("array<struct<session_id:string,occurred_at:string>>")
    narrow = lambda ev: F.coalesce(F.transform(ev, lambda e: F.struct(e["session_id"].alias("session_id"), e["occurred_at"].alias("occurred_at"))), none)
    fields = ["before_evidence", "after_evidence", "evidence"] if section == "shifts" else ["evidence", "side_a_evidence", "side_b_evidence"]
    return F.concat(*(narrow(item[f]) for f in fields))


def project(reviews: DataFrame, sessions: DataFrame) -> DataFrame:
    """Observations of the visible shifts, insights and tensions of eligible reviews.

    reviews: review_id, prompt_version, detected_at and an array of items for each section; sessions: session_id,
    occurred_at, for evidence without a day of its own. Refs keep an item's place in its section, hidden ones counted.
    """
    fit = eligibility(reviews).where("skip_reason IS NULL")
    parts = []
    for section, (kind, ref) in SECTIONS.items():
        rows = fit.select("review_id", "detected_at", F.posexplode(section).alias("pos", "item")).where(visible(F.col("item")))
        claim = F.trim(F.coalesce(F.nullif(F.trim(F.col("item.interpretation")), F.lit("")), F.col("item.text"))) if section == "shifts" else F.trim("item.text")
        parts.append(rows.select("review_id", "detected_at", F.lit(kind).alias("kind"), F.format_string(f"R:{ref.upper()}:%02d", F.col("pos") + 1).alias("source_ref"), claim.alias("title"), F.col("item.support_type").alias("support_type"), F.col("item.distinct_session_count").alias("given_count"), _evidence(F.col("item"), section).alias("ev")))
    flat = parts[0].unionByName(parts[1]).unionByName(parts[2])
    days = flat.select("review_id", "source_ref", F.posexplode_outer("ev").alias("n", "e")).select("review_id", "source_ref", "n", F.nullif("e.session_id", F.lit("")).alias("session_id"), F.nullif("e.occurred_at", F.lit("")).alias("own_day"))
    days = days.join(sessions.select("session_id", F.col("occurred_at").alias("session_day")), "session_id", "left")
    day = F.coalesce("own_day", "session_day")
    order = F.array_sort(F.collect_list(F.when(F.col("session_id").isNotNull(), F.struct("n", "session_id"))))
    seen = days.groupBy("review_id", "source_ref").agg(F.min(day).alias("first_seen_at"), F.max(day).alias("last_seen_at"), F.array_distinct(F.transform(order, lambda x: x["session_id"])).alias("session_ids"))
    out = flat.drop("ev").join(seen, ["review_id", "source_ref"])
    return out.select("review_id", "source_ref", F.lit(PROJECTION_VERSION).alias("projection_version"), "kind", "title", F.col("title").alias("body"), "support_type", "first_seen_at", "last_seen_at", "detected_at", "session_ids", F.coalesce("given_count", F.size("session_ids")).alias("distinct_session_count"))


IDENTITY = ["review_id", "source_ref", "projection_version"]


def new_observations(projected: DataFrame, existing: DataFrame) -> DataFrame:
    """Those to insert: not there yet, each once."""
    return joins.missing(projected.dropDuplicates(IDENTITY), existing, IDENTITY)


def backfill_counts(reviews: DataFrame, projected: DataFrame, existing: DataFrame) -> DataFrame:
    """One row: reviews considered, projected and skipped, observations inserted and already there."""
    a = eligibility(reviews).agg(F.count("*").alias("considered"), F.count_if(F.col("skip_reason").isNull()).alias("projected"), F.count("skip_reason").alias("skipped"))
    once = projected.dropDuplicates(IDENTITY)
    b = joins.missing(once, existing, IDENTITY).agg(F.count("*").alias("inserted"))
    c = joins.present(once, existing, IDENTITY).agg(F.count("*").alias("skipped_existing"))
    return a.join(F.broadcast(b)).join(F.broadcast(c))  # three single rows


def _digested(reviews: DataFrame) -> DataFrame:
    return reviews.withColumn("digest", F.sha2(F.to_json(F.struct(*reviews.columns)), 256))


def store_tables(reviews: DataFrame, sessions: DataFrame) -> dict[str, tuple[DataFrame, list[str]]]:
    """The tables of a store that backfill_changes writes, with their keys: observations, and the reviews that were projected."""
    return {"observations": (project(reviews, sessions), IDENTITY), "projected_reviews": (_digested(reviews).select("review_id", "digest"), ["review_id", "digest"])}


def backfill_changes(store, run: str, reviews: DataFrame, sessions: DataFrame) -> tuple[int, int, int]:
    """Projects the reviews that are new, or have another content than when they were projected, and adds the observations that aren't
    there yet: (reviews read, of these changed, observations added). A review that is unchanged isn't read beyond its digest."""
    digested = _digested(reviews)
    seen = store.read("projected_reviews")
    fresh = kept(joins.missing(digested, seen, ["review_id", "digest"]), "reviews")
    changed = joins.present(fresh, seen.select("review_id").distinct(), ["review_id"])
    counts = fresh.count(), changed.count()
    tables = store_tables(fresh.drop("digest"), sessions)
    done = store.commit(run, {"observations": tables["observations"][0], "projected_reviews": fresh.select("review_id", "digest")})
    return *counts, done["observations"]


SUPPORTS = ["direct", "cross_session_interpretation", "hypothesis"]
_SIDE = StructType([StructField("text", StringType())])
_TEXTS = ["text", "interpretation", "before", "after", "relationType", "supportType"]
_PAYLOAD = StructType([StructField(c, StringType()) for c in _TEXTS] + [StructField("semanticValid", BooleanType()), StructField("sideA", _SIDE), StructField("sideB", _SIDE)])


def from_records(records: DataFrame) -> DataFrame:
    """Stored observations to what pages show: adds `item`, the payload. Records of other kinds, with a payload that is not valid JSON or lacks
    what its kind needs, and hidden ones are left out; a missing support type is that of the record, if it is one."""
    shift = F.col("kind") == "shift"
    item = F.when(shift, parse_strict(F.col("payload"), _PAYLOAD, {"interpretation", "before", "after"})).otherwise(parse_strict(F.col("payload"), _PAYLOAD, {"text"}))
    rows = records.where(F.col("kind").isin("shift", "connection", "tension")).withColumn("item", item)
    rows = rows.where(F.col("item").isNotNull() & F.coalesce("item.semanticValid", F.lit(True)))
    own = F.when(F.col("support_type").isin(SUPPORTS), F.col("support_type"))
    return rows.withColumn("support_type", F.coalesce("item.supportType", own)).drop("payload")


def cards(observations: DataFrame) -> DataFrame:
    """The card of each observation with an item: labels, dates, and a struct for what its kind has."""
    kind, item = F.col("kind"), F.col("item")
    of = lambda name, **fields: F.when(kind == name, F.struct(*(v.alias(k) for k, v in fields.items()))).alias(name)
    return observations.select(
        "id", "kind", L.kind_label(kind).alias("kind_label"), L.spotlight_label(kind).alias("spotlight_label"), "title", "body", thought_date(F.col("last_seen_at"), F.col("first_seen_at")).alias("thought_date"), "first_seen_at", "last_seen_at", "review_id",
        *(c for c in ("review_title", "sessions", "spotlight") if c in observations.columns), of("shift", before=item["before"], after=item["after"], interpretation=item["interpretation"]),
        of("connection", text=item["text"], relation_type=item["relationType"], relation_label=L.relation_label(item["relationType"])), of("tension", text=item["text"], side_a=item["sideA"]["text"], side_b=item["sideB"]["text"]),
    )


def home_model(observations: DataFrame, sessions: DataFrame, reviews: DataFrame, now: Column) -> DataFrame:
    """The cards of a home page: the latest five of each kind, and the one that deserves to be shown first (spotlight is true), which may
    be one of them."""
    listed = home(observations, sessions, reviews)
    named = observations.withColumn("id", F.concat_ws("/", *IDENTITY))
    best = ranking.spotlight(named, now, 1).select("id", F.lit(True).alias("spotlight"))
    one = named.join(F.broadcast(best), "id", "left_semi")  # a single row
    alone = home(one.drop("id"), sessions, reviews).join(listed.select("id"), "id", "left_anti")
    return cards(listed.unionByName(alone).join(F.broadcast(best), "id", "left").withColumn("spotlight", F.coalesce("spotlight", F.lit(False))))


def home(observations: DataFrame, sessions: DataFrame, reviews: DataFrame) -> DataFrame:
    """The latest five of each kind, with the titles of their sessions and review; unknown sessions are left out."""
    o = observations.where(F.col("kind").isin("shift", "connection", "tension"))
    o = o.withColumn("id", F.concat_ws("/", *IDENTITY)).withColumn("key", F.coalesce("last_seen_at", "first_seen_at", "detected_at"))
    best = ranking.top_n(o, ["kind"], [F.desc("key"), F.asc("id")], PER_KIND)
    who = best.select("id", F.posexplode("session_ids").alias("n", "session_id")).join(sessions.select("session_id", "title"), "session_id")
    named = who.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "session_id", "title"))), lambda s: F.struct(s["session_id"].alias("session_id"), s["title"].alias("title"))).alias("sessions"))
    out = best.drop("session_ids").join(named, "id", "left").withColumn("sessions", F.coalesce("sessions", F.array().cast("array<struct<session_id:string,title:string>>")))
    return out.join(reviews.select("review_id", F.col("title").alias("review_title")), "review_id", "left")
