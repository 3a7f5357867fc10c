"""Queries over state that earlier rows leave behind: registries of concepts, stores and runs. With SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates, labels
from ..operators import guards, ranking, units
from ..shared import kept, shared_dir
from ..sources import export, sinks
from ..sources.store import Store
from . import admission, analysis, concepts, observations
from .derived import _ALLOWED, _CITED, _HARD, _KINDS, _ROLE, _SOFT, _SUBJECTS, _UNITS, _cited, _review_rows, _said, _session_days, _term
from .queries import _table, query

#: What the derived actions name, and the registry that each owner has before: ref, id, label, aliases ("shared" is ambiguous).
LABELS = ["Alpha", "al", "shared", "Beta", "delta", "今日", "epsilon", "田中さん", "zeta", "A vs B", "eta", "gamma", "theta"]
SEEDS = [("C01", "k-alpha", "Alpha", ["al", "shared"]), ("C02", "k-beta", "Beta", ["shared"]), ("C03", "k-gamma", "Gamma", [])]


def _listed(values) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


_KEYS = [x.replace(" ", "").lower() for x in LABELS]
_BAD = {"今日": "invalid_candidate", "田中さん": "honorific_person", "A vs B": "invalid_candidate"}
_DETAIL = {"今日": "generic_term", "A vs B": "compound_relation"}
_RESOLVED = f"""
    a AS (
        SELECT conv_id // 20 AS owner, conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id // 20 ORDER BY conv_id, turn) AS BIGINT) AS i, (conv_id + 2 * turn) % 8 AS kind,
            {_listed(LABELS)}[1 + (conv_id * 5 + turn * 3) % 13] AS label, {_listed(_KEYS)}[1 + (conv_id * 5 + turn * 3) % 13] AS key, {_listed(map(_BAD.get, LABELS))}[1 + (conv_id * 5 + turn * 3) % 13] AS bad,
            {_listed(map(_DETAIL.get, LABELS))}[1 + (conv_id * 5 + turn * 3) % 13] AS bad_detail, CASE WHEN (conv_id + turn) % 5 > 0 THEN 1 + (conv_id * 3 + turn) % 9 END AS ref FROM conversations
    ), k AS (
        SELECT *, CASE WHEN kind IN (4, 5, 6) THEN 'match' ELSE 'new' END AS action, kind NOT IN (0, 1, 7) AS live,
            CASE key WHEN 'alpha' THEN 'k-alpha' WHEN 'beta' THEN 'k-beta' WHEN 'gamma' THEN 'k-gamma' END AS own, CASE key WHEN 'al' THEN 'k-alpha' END AS alias FROM a
    ), r AS (
        SELECT owner, CAST(0 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS conv_id, CAST([] AS VARCHAR[]) AS made, CAST([] AS BIGINT[]) AS batches, CAST([] AS VARCHAR[]) AS unit, CAST(NULL AS VARCHAR) AS status,
            CAST(NULL AS VARCHAR) AS reason, CAST(NULL AS VARCHAR) AS detail, CAST(NULL AS VARCHAR) AS concept, false AS exact, false AS maybe, CAST(-1 AS BIGINT) AS turn FROM (SELECT DISTINCT owner FROM a)
        UNION ALL
        SELECT owner, i, conv_id, CASE WHEN grows THEN list_append(made, key) ELSE made END, CASE WHEN grows THEN list_append(batches, conv_id) ELSE batches END, CASE WHEN status = 'accepted' THEN list_append(unit, concept) ELSE unit END,
            status, CASE status WHEN 'rejected' THEN reason END, CASE status WHEN 'rejected' THEN detail END, concept, exact, maybe, turn
        FROM (
            SELECT *, status = 'accepted' AND own IS NULL AND alias IS NULL AND NOT list_contains(made, key) AS grows
            FROM (
                SELECT *, CASE WHEN kind = 0 THEN 'skip' WHEN kind = 1 THEN 'uncertain' WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS status
                FROM (
                    SELECT *, CASE WHEN kind = 7 THEN 'surface_not_in_unit' WHEN NOT live THEN NULL WHEN action = 'match' AND NOT served AND NOT there THEN 'unknown_concept_ref' WHEN NOT (action = 'match' AND served) AND bad IS NOT NULL THEN bad
                            WHEN list_contains(unit, concept) THEN 'duplicate_concept_in_unit' WHEN len(unit) >= 3 THEN 'max_concepts_per_unit' END AS reason,
                        CASE WHEN NOT live THEN NULL WHEN action = 'match' AND NOT served AND NOT there THEN printf('C%02d', ref) WHEN NOT (action = 'match' AND served) AND bad IS NOT NULL THEN bad_detail END AS detail,
                        live AND action = 'match' AND NOT served AND there AS maybe
                    FROM (
                        SELECT *, exact OR alias IS NOT NULL AS served, coalesce(ref <= 3 + len(made), false) AS there, coalesce(own, alias, 'virtual:' || key) AS concept
                        FROM (
                            SELECT k.*, r.made, r.batches, CASE WHEN r.conv_id = k.conv_id THEN r.unit ELSE CAST([] AS VARCHAR[]) END AS unit, k.own IS NOT NULL OR list_contains(r.made, k.key) AS exact
                            FROM r JOIN k ON k.owner = r.owner AND k.i = r.i + 1
                        )
                    )
                )
            )
        )
    ), o AS (
        SELECT r.*, k.key, k.ref, k.alias, k.own, CAST(list_position(made, k.key) AS BIGINT) AS place FROM r JOIN k ON k.owner = r.owner AND k.i = r.i
    ), e AS (
        SELECT owner, arg_max(made, i) AS all_made FROM r GROUP BY owner
    ), z AS (
        SELECT o.owner, o.conv_id, o.turn, status, CASE WHEN status <> 'accepted' THEN NULL WHEN concept = 'k-alpha' THEN 'C01' WHEN concept = 'k-beta' THEN 'C02' WHEN concept = 'k-gamma' THEN 'C03' ELSE printf('C%02d', 3 + place) END AS concept_ref,
            CASE WHEN status <> 'accepted' THEN NULL WHEN own IS NULL AND alias IS NULL AND batches[place] = o.conv_id THEN 'new' ELSE 'match' END AS resolved_as,
            CASE WHEN status <> 'accepted' THEN NULL WHEN exact THEN 'exact' WHEN alias IS NOT NULL THEN 'observed_alias' WHEN maybe THEN 'semantic' END AS match_kind, reason, detail, CAST(NULL AS VARCHAR) AS candidate_ref FROM o
        UNION ALL
        SELECT o.owner, o.conv_id, o.turn, 'provisional_match', NULL, NULL, 'semantic', NULL, NULL, printf('C%02d', ref) FROM o WHERE maybe
    )"""


def _registry(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Actions of all kinds, and the seeds of each owner's registry."""
    i, t = F.col("conv_id"), F.col("turn")
    kind = (i + 2 * t) % 8
    label = F.element_at(F.array(*map(F.lit, LABELS)), (1 + (i * 5 + t * 3) % len(LABELS)).cast("int"))
    rows = _table(spark, sf_dir, "conversations").select(
        F.floor(i / 20).alias("owner"), "conv_id", "turn", i.cast("string").alias("session_id"), i.alias("batch_no"), F.struct("conv_id", "turn").alias("pos"), F.lit("M001:E01").alias("evidence_ref"),
        F.when(kind == 0, "skip").when(kind == 1, "uncertain").when(kind.isin(4, 5, 6), "match").otherwise("new").alias("action"), label.alias("surface_form"),
        F.when((i + t) % 5 > 0, F.format_string("C%02d", 1 + (i * 3 + t) % 9)).alias("existing_ref"), F.when(kind == 7, "surface_not_in_unit").alias("ground_reason"),
    )
    seeds = spark.createDataFrame(SEEDS, concepts._SEEDS)
    owners = rows.select("owner").distinct().withColumn("seed", F.explode(F.array(*(F.struct(*(F.array(*map(F.lit, x)).cast("array<string>").alias(n) if isinstance(x, list) else F.lit(x).alias(n) for n, x in zip(seeds.columns, s, strict=True))) for s in SEEDS))))
    return rows, owners.select("owner", "seed.*")


@query(f"WITH RECURSIVE {_RESOLVED} SELECT * FROM z")
def registry_outcomes(spark, sf_dir):
    """Actions against registries that exist: aliases, an ambiguous one, refs that are known, not yet known or wrong, all reasons and limits."""
    rows, seeds = _registry(spark, sf_dir)
    return concepts.resolve(rows, ["owner"], seeds).select("owner", "conv_id", "turn", "status", "concept_ref", "resolved_as", "match_kind", "reason", "detail", "candidate_ref")


@query(f"""WITH RECURSIVE {_RESOLVED}, s AS (SELECT * FROM (VALUES {", ".join(f"('{r}', '{c}', {_listed(a)})" for r, _, c, a in SEEDS)}) AS v(concept_ref, canonical_label, aliases))
    SELECT owner, string_agg(line, chr(10) ORDER BY ref) AS catalog_text FROM (
        SELECT owner, concept_ref AS ref, concept_ref || ' | ' || canonical_label || CASE WHEN len(aliases) > 0 THEN ' | aliases: ' || array_to_string(aliases, ', ') ELSE '' END AS line FROM s, (SELECT DISTINCT owner FROM a)
        UNION ALL SELECT owner, printf('C%02d', 3 + n), printf('C%02d', 3 + n) || ' | ' || {_listed(LABELS)}[list_position({_listed(_KEYS)}, all_made[n])] FROM (SELECT owner, all_made, unnest(range(1, len(all_made) + 1)) AS n FROM e)
    ) GROUP BY owner""")
def registry_catalog(spark, sf_dir):
    """What an annotator reads of each owner's registry after the actions."""
    rows, seeds = _registry(spark, sf_dir)
    return concepts.catalog_text(concepts.catalog(concepts.resolve(rows, ["owner"], seeds), ["owner"], seeds), ["owner"])


@query(f"WITH RECURSIVE {_RESOLVED} SELECT owner, count(*) FILTER (status = 'accepted' AND resolved_as = 'match') AS match, count(DISTINCT CASE WHEN resolved_as = 'new' THEN concept_ref END) AS new, count(*) FILTER (status = 'skip') AS skip, count(*) FILTER (status = 'uncertain') AS uncertain, count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (status = 'accepted') AS occurrences, count(DISTINCT concept_ref) AS unique_concepts, count(*) FILTER (status = 'provisional_match') AS provisional_match FROM z GROUP BY owner")
def registry_metrics(spark, sf_dir):
    """Outcomes of each kind of each owner's actions."""
    rows, seeds = _registry(spark, sf_dir)
    return concepts.metrics(concepts.resolve(rows, ["owner"], seeds), ["owner"])


@query("""
    WITH h AS (
        SELECT 'C' || p_partkey AS ref, list_reduce(list_concat([CAST(2166136261 AS BIGINT)], list_transform(string_split('seed:C' || p_partkey, ''), lambda c: CAST(ord(c) AS BIGINT))), lambda a, c: xor(a, c) * 16777619 % 4294967296) AS hash FROM part
    ), n AS (SELECT *, row_number() OVER (ORDER BY hash, ref) AS place, count(*) OVER () AS n FROM h),
    k AS (SELECT *, greatest(1, CAST(floor(n / 6.0 + 0.5) AS BIGINT)) AS k FROM n)
    SELECT ref, hash, place, CAST(CASE WHEN place - 1 < (n % k) * (n // k + 1) THEN (place - 1) // (n // k + 1) ELSE n % k + (place - 1 - (n % k) * (n // k + 1)) // (n // k) END + 1 AS INTEGER) AS batch_no FROM k""")
def batches_over_all(spark, sf_dir):
    """A whole table dealt into batches of about six in the order of a hash."""
    p = _table(spark, sf_dir, "part").select(F.concat(F.lit("C"), F.col("p_partkey").cast("string")).alias("ref"))
    return ranking.batches_over_all(p, "ref", "seed").select("ref", "hash", "place", "batch_no")


# Batches of six customers are assessed; three of four first calls have a fault, often two; a batch in eight fails twice, one call gives nothing.
_CALLS = """
    c AS (SELECT c_custkey AS pos, 'C' || c_custkey AS ref, c_custkey // 6 AS batch_no, c_custkey % 6 AS k FROM customer),
    calls AS (SELECT DISTINCT batch_no, 1 AS attempt FROM c UNION SELECT DISTINCT batch_no, 2 FROM c WHERE batch_no % 4 > 0),
    given AS (
        SELECT batch_no, attempt, pos, k, CASE WHEN attempt = 1 AND batch_no % 4 = 3 AND k = 4 THEN 'Z' || pos WHEN attempt = 1 AND batch_no % 4 = 1 AND k = 5 THEN 'C' || (pos - 1) ELSE ref END AS ref,
            CASE WHEN attempt = 1 AND batch_no % 4 = 1 AND k IN (3, 4) THEN 'odd' ELSE 'pii' END AS form, CASE WHEN batch_no % 8 = 7 AND k = 2 THEN 'odd' ELSE 'central' END AS role, CASE WHEN attempt = 1 AND batch_no % 4 = 1 AND k = 3 THEN 'odd' ELSE 'low' END AS potential
        FROM c JOIN calls USING (batch_no) WHERE NOT (attempt = 1 AND batch_no % 4 = 2 AND (k IN (1, 4) OR batch_no % 3 = 0))
    ), v AS (
        SELECT g.*, CASE WHEN c.ref IS NULL THEN 'unknown_candidate_ref' WHEN row_number() OVER (PARTITION BY g.batch_no, attempt, g.ref ORDER BY g.pos) > 1 THEN 'duplicate_candidate_ref' WHEN form = 'odd' THEN 'invalid_concept_form' WHEN role = 'odd' THEN 'invalid_evidence_role' WHEN potential = 'odd' THEN 'invalid_longitudinal_potential' END AS reason
        FROM given g LEFT JOIN c ON c.batch_no = g.batch_no AND c.ref = g.ref
    ), bad AS (SELECT batch_no, attempt, arg_min(reason, pos) AS reason, arg_min(ref, pos) AS detail FROM v WHERE reason IS NOT NULL GROUP BY batch_no, attempt),
    gone AS (SELECT calls.batch_no, attempt, arg_min(c.ref, c.pos) AS detail FROM calls JOIN c USING (batch_no) WHERE NOT EXISTS (SELECT 1 FROM given g WHERE g.batch_no = calls.batch_no AND g.attempt = calls.attempt AND g.ref = c.ref) GROUP BY calls.batch_no, attempt),
    f AS (SELECT calls.batch_no, calls.attempt, coalesce(bad.reason, CASE WHEN gone.detail IS NOT NULL THEN 'missing_candidate_ref' END) AS reason, coalesce(bad.detail, gone.detail) AS detail
        FROM calls LEFT JOIN bad ON bad.batch_no = calls.batch_no AND bad.attempt = calls.attempt LEFT JOIN gone ON gone.batch_no = calls.batch_no AND gone.attempt = calls.attempt)"""


def _calls(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    key = F.col("c_custkey")
    c = _table(spark, sf_dir, "customer").select(key.alias("pos"), F.concat(F.lit("C"), key.cast("string")).alias("ref"), F.floor(key / 6).alias("batch_no"), (key % 6).alias("k"))
    b, k, first = F.col("batch_no"), F.col("k"), F.col("attempt") == 1
    calls = c.select("batch_no").distinct().withColumn("attempt", F.explode(F.when(b % 4 > 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    ref = F.when(first & (b % 4 == 3) & (k == 4), F.concat(F.lit("Z"), F.col("pos").cast("string"))).when(first & (b % 4 == 1) & (k == 5), F.concat(F.lit("C"), (F.col("pos") - 1).cast("string"))).otherwise(F.col("ref"))
    given = c.join(calls, "batch_no").where(~(first & (b % 4 == 2) & (k.isin(1, 4) | (b % 3 == 0)))).select(
        "batch_no", "attempt", "pos", ref.alias("candidate_ref"), F.when(first & (b % 4 == 1) & k.isin(3, 4), "odd").otherwise("pii").alias("concept_form"),
        F.when((b % 8 == 7) & (k == 2), "odd").otherwise("central").alias("evidence_role"), F.when(first & (b % 4 == 1) & (k == 3), "odd").otherwise("low").alias("longitudinal_potential"),
    )
    return c.drop("k"), calls, given


@query(f"WITH {_CALLS} SELECT CAST(batch_no AS BIGINT) AS batch_no, CAST(attempt AS INTEGER) AS attempt, reason, detail FROM f")
def assessment_calls(spark, sf_dir):
    """Each call of an annotator of batches with its first failure, or none."""
    return admission.assessment_failures(*_calls(spark, sf_dir))


@query(f"""WITH {_CALLS}, good AS (SELECT batch_no, max(attempt) AS attempt FROM f WHERE reason IS NULL GROUP BY batch_no), one AS (SELECT batch_no, arg_max(reason, attempt) AS reason, arg_max(detail, attempt) AS detail FROM f WHERE attempt = 1 GROUP BY batch_no)
    SELECT CAST(c.pos AS BIGINT) AS pos, c.ref, CAST(g.attempt AS INTEGER) AS attempt, g.form AS concept_form, one.reason AS repaired, CASE WHEN good.batch_no IS NULL THEN f.reason || ':' || f.detail END AS failed
    FROM c LEFT JOIN good USING (batch_no) LEFT JOIN given g ON g.batch_no = c.batch_no AND g.attempt = good.attempt AND g.ref = c.ref LEFT JOIN one ON one.batch_no = c.batch_no LEFT JOIN f ON f.batch_no = c.batch_no AND f.attempt = 2""")
def assessment_repairs(spark, sf_dir):
    """Batches that failed go out once more; the latest valid call counts, and candidates come in their order with it or with what failed."""
    c, calls, given = _calls(spark, sf_dir)
    failures = admission.assessment_failures(c, calls, given)
    told = admission.repairs(failures.where("attempt = 1")).select("batch_no", F.col("reason").alias("repaired"))
    counts, failed = admission.settled(failures, given)
    failed = failed.select("batch_no", F.concat_ws(":", "reason", "detail").alias("failed"))
    own = counts.select(F.col("candidate_ref").alias("ref"), "attempt", "concept_form")
    return c.join(own, "ref", "left").join(told, "batch_no", "left").join(failed, "batch_no", "left").select("pos", "ref", "attempt", "concept_form", "repaired", "failed")


def _new_store(spark, tables: dict, references: list = ()) -> Store:
    """An empty store for rows like those of tables: (rows, keys) by name."""
    return Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", {n: list(k) for n, (_, k) in tables.items()}, {n: r.schema for n, (r, _) in tables.items()}, references)


@query("""
    WITH m AS (SELECT conv_id, turn, role FROM conversations), s AS (SELECT conv_id, count(*) AS n, count(*) FILTER (role = 'user') AS u FROM m GROUP BY conv_id),
    a AS (SELECT *, CASE WHEN conv_id % 10 = 0 THEN 0 WHEN conv_id % 5 = 0 THEN 2 ELSE n END AS parsed, conv_id % 7 = 0 AS gone, conv_id % 2 = 1 AS late FROM s)
    SELECT 'sessions' AS name, count(*) FILTER (NOT gone) AS rows, count(*) FILTER (NOT late) AS first, count(*) FILTER (late) AS second, count(*) FILTER (gone) AS deleted FROM a
    UNION ALL SELECT 'messages', CAST(sum(parsed) FILTER (NOT gone) AS BIGINT), CAST(sum(n) FILTER (NOT late) AS BIGINT), CAST(sum(n) FILTER (late) AS BIGINT), CAST(coalesce(sum(parsed) FILTER (gone), 0) AS BIGINT) FROM a
    UNION ALL SELECT 'analyses', count(*) FILTER (NOT gone), 0, count(*), count(*) FILTER (gone) FROM a
    UNION ALL SELECT 'evidences', CAST(coalesce(sum(u) FILTER (NOT gone), 0) AS BIGINT), 0, CAST(sum(u) AS BIGINT), CAST(coalesce(sum(u) FILTER (gone), 0) AS BIGINT) FROM a
    UNION ALL SELECT 'session_status', count(*) FILTER (NOT gone), 0, count(*), count(*) FILTER (gone) FROM a
    UNION ALL SELECT 'reviews', count(DISTINCT conv_id // 20), 0, count(DISTINCT conv_id // 20), 0 FROM a
    UNION ALL SELECT 'review_sessions', count(*) FILTER (NOT gone), 0, count(*), count(*) FILTER (gone) FROM a
    UNION ALL SELECT 'packs', count(DISTINCT conv_id // 50), 0, count(DISTINCT conv_id // 50), 0 FROM a
    UNION ALL SELECT 'pack_sessions', count(*) FILTER (NOT gone), 0, count(*), count(*) FILTER (gone) FROM a""")
def store_runs(spark, sf_dir):
    """A store of nine tables: half of the sessions, then all with their analyses, reviews and packs, messages of some parsed again (of
    some from a text that is now empty), and sessions deleted with all that hangs on them. Rows that are left, and what each run did."""
    c = _table(spark, sf_dir, "conversations")
    i = F.col("conv_id")
    id_ = i.cast("string").alias("session_id")
    sessions = c.select(id_, "conv_id").distinct().select("session_id", "conv_id", F.concat(F.lit("Conversation "), "session_id").alias("title"))
    messages = c.select(id_, F.col("turn").cast("int").alias("index"), "role", F.col("text").alias("content"))
    item = F.struct(F.array(F.struct(F.concat_ws(":", i.cast("string"), F.col("turn").cast("string")).alias("message_id"), F.substring("text", 1, 20).alias("quote"), F.lit(True).alias("validated"))).alias("evidence"))
    items = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == "user", F.struct("turn", item.alias("i"))))), lambda x: x["i"]).alias("items"))
    analysed = sinks.analysis_tables(items.select(F.concat(F.lit("a"), i.cast("string")).alias("analysis_id"), id_, "items"))
    analysed["analyses"] = (analysed["analyses"][0].drop("items"), analysed["analyses"][1])
    grouped = lambda n, name: c.select(F.floor(i / n).alias(name), id_).distinct().groupBy(name).agg(F.collect_list("session_id").alias("session_ids"))
    reviews, packs = sinks.bridge_tables(grouped(20, "review_id"), "review_id", "session_ids", "review"), sinks.bridge_tables(grouped(50, "pack_id"), "pack_id", "session_ids", "pack")
    tables = {"sessions": (sessions.drop("conv_id"), ["session_id"]), "messages": (messages, ["session_id", "index"])} | analysed | reviews | packs
    below = [("sessions", n, "session_id") for n in ("messages", "analyses", "evidences", "session_status", "review_sessions", "pack_sessions")]
    store = _new_store(spark, tables, [*below, ("analyses", "evidences", "analysis_id"), ("reviews", "review_sessions", "review_id"), ("packs", "pack_sessions", "pack_id")])
    even = sessions.where(i % 2 == 0)
    first = store.commit("first", {"sessions": even, "messages": messages.join(even, "session_id", "left_semi")})
    second = store.commit("second", {n: rows for n, (rows, _) in tables.items()})
    again = sessions.where(i % 5 == 0).select("session_id", F.when(i % 10 == 0, " ").otherwise("User: hi\nAssistant: yes").alias("raw_content"))
    parsed = sinks.parsed_sessions(again)[1].where(F.trim("content") != "").select("session_id", F.col("index").cast("int").alias("index"), "role", "content")
    store.replace("parsed", "messages", "session_id", again, parsed)
    deleted = store.cascade("deleted", "sessions", sessions.where(i % 7 == 0))
    parts = [store.read(n).agg(F.lit(n).alias("name"), F.count("*").alias("rows"), *(F.lit(d.get(n, 0)).cast("long").alias(k) for k, d in (("first", first), ("second", second), ("deleted", deleted)))) for n in tables]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("""
    WITH r AS (SELECT DISTINCT conv_id // 20 AS review_id FROM conversations), i AS (SELECT DISTINCT conv_id, conv_id // 20 AS review_id FROM conversations),
    v AS (SELECT review_id, count(*) FILTER (conv_id % 7 <> 0 AND review_id % 4 <> 3) AS items FROM i GROUP BY review_id)
    SELECT 'first' AS run, count(*) AS considered, CAST(0 AS BIGINT) AS changed, CAST(sum(items) AS BIGINT) AS inserted FROM v UNION ALL SELECT 'again', 0, 0, 0
    UNION ALL SELECT 'later', count(*) FILTER (review_id % 3 = 0), count(*) FILTER (review_id % 3 = 0), 0 FROM v""")
def observation_changes(spark, sf_dir):
    """Reviews projected to observations, the same again, and again after a third of them has changed: only these are read."""
    reviews, days = _review_rows(spark, sf_dir), _session_days(spark, sf_dir)
    store = _new_store(spark, observations.store_tables(reviews, days))
    later = reviews.withColumn("detected_at", F.when(F.col("review_id") % 3 == 0, "2024-03-01").otherwise(F.col("detected_at")))
    runs = [(n, *observations.backfill_changes(store, n, r, days)) for n, r in (("first", reviews), ("again", reviews), ("later", later))]
    return spark.createDataFrame(runs, "run string, considered long, changed long, inserted long")


@query(f"""WITH {_CITED}, o AS (SELECT conv_id, turn, bool_or(NOT ok AND why = 'quote_not_found') AS invalid, coalesce(list_sort(list(DISTINCT s) FILTER (ok)), []) AS ss FROM e GROUP BY conv_id, turn),
    p AS (SELECT x.conv_id, x.turn, x.invalid OR y.invalid AS side_invalid, len(x.ss) = 1 AND len(y.ss) = 1 AND x.ss = y.ss AS one FROM o x JOIN o y ON y.conv_id = x.conv_id + 1 AND y.turn = x.turn)
    SELECT conv_id, turn, CASE WHEN invalid OR side_invalid THEN 'invalid_evidence_ref|hard' WHEN one THEN 'insufficient_distinct_sessions|interpretation' {_HARD} WHEN n < 2 THEN 'insufficient_distinct_sessions|interpretation' {_SOFT} ELSE '|interpretation' END AS verdict
    FROM a JOIN p USING (conv_id, turn)""")
def tension_verdicts(spark, sf_dir):
    """Tensions between what is cited at a turn and at the same turn of the next conversation: the whole verdict of each."""
    a = _cited(spark, sf_dir)
    sides = a.where(F.size("evidence") > 0).select("conv_id", "turn", F.col("evidence").alias("a"))
    rows = a.join(sides, ["conv_id", "turn"]).join(sides.select((F.col("conv_id") - 1).alias("conv_id"), "turn", F.col("a").alias("b")), ["conv_id", "turn"])
    return rows.select("conv_id", "turn", _said(guards.tension(F.col("claim"), F.col("evidence"), F.col("a"), F.col("b"))).alias("verdict"))


@query(f"""WITH RECURSIVE {_UNITS}, it AS (
        SELECT conv_id, turn, {_listed(_KINDS)}[1 + (conv_id + turn) % 6] AS kind, {_listed(_SUBJECTS)}[1 + conv_id % 4] AS subject,
            CASE (conv_id + turn) % 4 WHEN 0 THEN [ref] WHEN 1 THEN [ref, 'M999:E01'] WHEN 2 THEN ['M001:E01', ref] ELSE CAST([] AS VARCHAR[]) END AS refs FROM u WHERE unit_no = 1
    ), ex AS (SELECT conv_id, turn, unnest(refs) AS r FROM it),
    ev AS (SELECT ex.conv_id, ex.turn, count(*) AS n_all, count(u.ref) AS n_ok, bool_or(u.ref IS NULL) AS invalid, bool_or(coalesce(u.role = 'user', false)) AS usr FROM ex LEFT JOIN u ON u.conv_id = ex.conv_id AND u.ref = ex.r GROUP BY ex.conv_id, ex.turn),
    x AS (SELECT it.*, coalesce(n_all, 0) AS n_all, coalesce(n_ok, 0) AS n_ok, coalesce(invalid, false) AS invalid, coalesce(usr, false) AS usr, coalesce(n_ok, 0) > 0 AS valid FROM it LEFT JOIN ev USING (conv_id, turn)),
    j AS (
        SELECT *, CASE WHEN NOT ({_ALLOWED}) THEN 'unsupported_subject_kind' WHEN invalid THEN 'invalid_evidence_ref' WHEN (kind IN ('decision', 'action') OR kind IN ('fact', 'insight') AND subject = 'user') AND NOT usr THEN {_ROLE} END AS why,
            CASE WHEN kind = 'fact' THEN NOT valid WHEN kind IN ('decision', 'action') THEN NOT usr ELSE false END AS unsupported FROM x
    )
    SELECT conv_id, 'Summary ' || conv_id AS summary, string_agg(kind || ':' || coalesce(why, 'ok') || CASE WHEN unsupported THEN '!' ELSE '' END, ',' ORDER BY turn) AS items, CAST(sum(n_all) AS BIGINT) AS evidence_count, CAST(sum(n_ok) AS BIGINT) AS validated_count,
        round(CASE WHEN sum(n_all) > 0 THEN sum(n_ok) / sum(n_all) ELSE 0 END, 9) AS validation_rate, count(*) AS semantic_item_count, count(*) FILTER (why IS NULL) AS semantic_valid_count, round(count(*) FILTER (why IS NULL) / count(*), 9) AS semantic_validation_rate
    FROM j GROUP BY conv_id""")
def session_analyses(spark, sf_dir):
    """Sessions analysed from an annotator's items and refs to stored payloads with their metrics."""
    i, t = F.col("conv_id"), F.col("turn")
    c = _table(spark, sf_dir, "conversations").withColumn("message_id", F.concat_ws(":", i.cast("string"), t.cast("string")))
    u = kept(units.evidence_units(c, ["conv_id"], ["turn"], content="text"), "units")
    refs = F.when((i + t) % 4 == 0, F.array("ref")).when((i + t) % 4 == 1, F.array(F.col("ref"), F.lit("M999:E01"))).when((i + t) % 4 == 2, F.array(F.lit("M001:E01"), F.col("ref"))).otherwise(F.array().cast("array<string>"))
    items = u.where("unit_no = 1").select("conv_id", t.alias("item_id"), _term(i + t, _KINDS).alias("kind"), _term(i, _SUBJECTS).alias("subject"), F.col("unit_text").alias("text"), refs.alias("refs"))
    analysed = kept(analysis.analyse(items, u, c.withColumnRenamed("text", "content"), ["conv_id"]), "analysed")
    summaries = items.select("conv_id").distinct().select("conv_id", F.concat(F.lit("Summary "), i.cast("string")).alias("summary"))
    out = analysis.payloads(analysed, summaries, ["conv_id"])
    shown = F.transform("items", lambda x: F.concat(x["kind"], F.lit(":"), F.coalesce(x["invalid_reason"], F.lit("ok")), F.when(x["unsupported_claim"], "!").otherwise("")))
    rates = {r: F.round(r, 9) for r in ("validation_rate", "semantic_validation_rate")}
    return out.withColumn("items", F.array_join(shown, ",")).withColumns(rates).select("conv_id", "summary", "items", "evidence_count", "validated_count", "validation_rate", "semantic_item_count", "semantic_valid_count", "semantic_validation_rate")


@query("""WITH c AS (SELECT DISTINCT conv_id FROM conversations)
    SELECT count(DISTINCT conv_id // 25) AS files, CAST(1 AS BIGINT) AS skipped_files, count(*) + count(*) FILTER (conv_id % 6 = 0) + count(*) FILTER (conv_id % 4 = 1) AS elements, count(*) FILTER (conv_id % 6 = 0) AS no_conversation, count(*) FILTER (conv_id % 4 = 1) AS repeated, count(*) AS conversations FROM c""")
def export_load(spark, sf_dir):
    """Conversations written as export files of 25, some twice and some broken, beside a file of another kind, and read as elements: counts
    of what is read and skipped."""
    i = F.col("conv_id")
    node = F.struct(F.col("turn").cast("string").alias("id"), F.struct("role", F.col("text").alias("parts")).alias("message"))
    c = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("turn").cast("string").alias("k"), node.alias("v")))).alias("mapping"))
    whole = F.struct(i.cast("string").alias("id"), F.lit('a "title" } ] {').alias("title"), "mapping")
    broken = F.struct(i.cast("string").alias("id"), F.lit("none").alias("title"), F.lit(None).cast(c.schema["mapping"].dataType).alias("mapping"))
    each = F.array_compact(F.array(whole, F.when(i % 4 == 1, whole), F.when(i % 6 == 0, broken)))
    files = c.select(F.floor(i / 25).alias("file"), F.explode(each).alias("e")).groupBy("file").agg(F.collect_list("e").alias("conversations"))
    path = f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"
    files.select("conversations").write.option("maxRecordsPerFile", 1).json(f"{path}/chats")
    spark.range(1).select(F.lit("not an export").alias("t")).coalesce(1).write.text(f"{path}/notes")
    return export.load_counts(spark, path, export.read_elements(spark, path))


@query("""WITH d AS (SELECT DISTINCT o_orderdate AS d FROM orders), p AS (SELECT d, unnest(['this-week', 'last-week', 'last-7-days', 'last-30-days', 'all']) AS preset FROM d),
    w AS (SELECT *, date_trunc('week', d) AS monday FROM p)
    SELECT strftime(d, '%Y-%m-%d') AS day, preset, CASE preset WHEN 'this-week' THEN strftime(monday, '%Y-%m-%d') WHEN 'last-week' THEN strftime(monday - INTERVAL 7 DAY, '%Y-%m-%d') WHEN 'last-7-days' THEN strftime(d - INTERVAL 6 DAY, '%Y-%m-%d') WHEN 'last-30-days' THEN strftime(d - INTERVAL 29 DAY, '%Y-%m-%d') ELSE '' END AS start_day,
        CASE preset WHEN 'this-week' THEN strftime(monday + INTERVAL 6 DAY, '%Y-%m-%d') WHEN 'last-week' THEN strftime(monday - INTERVAL 1 DAY, '%Y-%m-%d') WHEN 'all' THEN '' ELSE strftime(d, '%Y-%m-%d') END AS end_day FROM w""")
def preset_ranges(spark, sf_dir):
    """The ranges of a picker by name, as seen from each day."""
    d = _table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d")).distinct().withColumn("preset", F.explode(F.array(*map(F.lit, dates.PRESETS))))
    r = dates.preset_range(F.col("preset"), F.col("d"))
    return d.select(F.date_format("d", "yyyy-MM-dd").alias("day"), "preset", r["start"].alias("start_day"), r["end"].alias("end_day"))


@query("""WITH s AS (SELECT conv_id, sum(length(text)) AS chars FROM conversations GROUP BY conv_id), g AS (SELECT conv_id // 12 AS choice, count(*) FILTER (conv_id % 12 < (conv_id // 12) % 12) AS n, CAST(coalesce(sum(chars) FILTER (conv_id % 12 < (conv_id // 12) % 12), 0) AS BIGINT) AS chars FROM s GROUP BY conv_id // 12)
    SELECT choice, n, CASE n WHEN 0 THEN 'レビューするSessionを選んでください' WHEN 1 THEN '統合レビューには2件以上のSessionが必要です' END AS hint, '約 ' || format('{:,}', chars) || ' 文字' || CASE WHEN chars > 2000 THEN ' / 上限 2,000 文字' ELSE '' END AS estimate FROM g""")
def picker_choices(spark, sf_dir):
    """What a picker says of choices of no, one and more sessions."""
    i = F.col("conv_id")
    s = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(F.length("text")).alias("chars"))
    chosen = i % 12 < F.floor(i / 12) % 12
    g = s.groupBy(F.floor(i / 12).alias("choice")).agg(F.count_if(chosen).alias("n"), F.coalesce(F.sum(F.when(chosen, F.col("chars"))), F.lit(0)).alias("chars"))
    return g.select("choice", "n", labels.selection_hint(F.col("n")).alias("hint"), labels.input_estimate(F.col("chars"), 2000).alias("estimate"))
