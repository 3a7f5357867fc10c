"""The queries: each operator over the test tables, with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import labels as L
from ..functions import text as T
from ..operators import containment, joins, ranking, sessions, stats, units
from ..sources import export
from . import admission, concepts

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""
    WITH s AS (SELECT DISTINCT conv_id FROM conversations),
    m AS (SELECT conv_id, count(*) AS n, sum(length(text)) AS c FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id)
    SELECT conv_id, CAST(coalesce(n, 0) AS BIGINT) AS message_count, CAST(coalesce(c, 0) AS BIGINT) AS char_count, coalesce(n, 0) > 0 AS analyzable
    FROM s LEFT JOIN m USING (conv_id)""")
def conversation_stats(spark, sf_dir):
    m = _table(spark, sf_dir, "conversations")
    return stats.with_message_stats(m.select("conv_id").distinct(), m, ["conv_id"], content="text")


@query("""
    WITH m AS (SELECT conv_id, turn, lower(trim(role)) AS role FROM conversations WHERE lower(trim(role)) IN ('user', 'assistant')),
    n AS (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS message_no FROM m)
    SELECT conv_id, turn, role, message_no, printf('M%03d', message_no) AS message_ref FROM n""")
def message_refs(spark, sf_dir):
    return units.numbered_messages(_table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"]).select("conv_id", "turn", "role", "message_no", "message_ref")


@query("""
    WITH m AS (
        SELECT conv_id, turn, length(text) AS n, CASE role WHEN 'user' THEN 6 ELSE 11 END + length(text) + CASE WHEN row_number() OVER w > 1 THEN 2 ELSE 0 END AS size
        FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
    ), e AS (SELECT conv_id, turn, n, CAST(sum(size) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS char_end FROM m)
    SELECT conv_id, turn, CAST(char_end - n AS BIGINT) AS char_start, char_end FROM e""")
def transcript_offsets(spark, sf_dir):
    m = _table(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant"))
    return sessions.transcript_offsets(m, ["conv_id"], ["turn"], content="text").select("conv_id", "turn", "char_start", "char_end")


@query("""
    SELECT conv_id, string_agg(CASE role WHEN 'user' THEN 'User:' ELSE 'Assistant:' END || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS raw_content, count(*) AS n_messages
    FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id""")
def transcripts(spark, sf_dir):
    m = _table(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant"))
    return sessions.transcripts(m, ["conv_id"], ["turn"], content="text")


def _user_sessions(spark, sf_dir):
    return sessions.gap_sessions(_table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "ts")


_GAP_SQL = """
    WITH g AS (
        SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 5 HOUR THEN 1 ELSE 0 END AS cut FROM events
    ), s AS (
        SELECT *, CAST(sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM g
    ), p AS (
        SELECT user_id, session, count(*) AS n_messages, arg_min(ts, (ts, event_id)) AS start_at, arg_max(ts, (ts, event_id)) AS end_at FROM s GROUP BY user_id, session
    )"""


@query(_GAP_SQL + " SELECT * FROM p")
def gap_sessions(spark, sf_dir):
    return sessions.session_spans(_user_sessions(spark, sf_dir), ["user_id"], ["ts", "event_id"], "ts")


@query(
    _GAP_SQL
    + """, t AS (SELECT user_id, session, strftime(start_at, '%Y/%m/%d') AS d FROM p),
    n AS (SELECT *, row_number() OVER (PARTITION BY user_id, d ORDER BY session) AS k FROM t)
    SELECT user_id, session, 'User ' || user_id || ' — ' || d || CASE WHEN k > 1 THEN ' #' || k ELSE '' END AS title FROM n"""
)
def session_titles(spark, sf_dir):
    s = gap_sessions(spark, sf_dir)
    title = F.concat(F.lit("User "), F.col("user_id").cast("string"))
    return sessions.session_titles(s, ["user_id"], title, F.col("start_at"), F.lit("2026-01-01").cast("timestamp_ntz")).select("user_id", "session", "title")


@query("""
    SELECT user_id, event_id, event_type, value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def latest_per_user(spark, sf_dir):
    return ranking.latest(_table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id").select("user_id", "event_id", "event_type", "value")


@query("""
    SELECT event_type, CAST(row_number() OVER w AS INTEGER) AS rank, event_id, value FROM events
    WINDOW w AS (PARTITION BY event_type ORDER BY value DESC, event_id) QUALIFY rank <= 5""")
def top_n_per_kind(spark, sf_dir):
    return ranking.top_n(_table(spark, sf_dir, "events"), ["event_type"], [F.desc("value"), F.asc("event_id")], 5).select("event_type", "rank", "event_id", "value")


@query("""
    SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, o_totalprice FROM orders
    WHERE strftime(o_orderdate, '%Y-%m-%d') BETWEEN '1995-01-01' AND '1995-06-30' AND o_orderstatus = 'O' AND contains(lower(o_orderpriority), 'high')""")
def picker_filter(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    start = F.lit("1995-01-01 00:00:00").cast("timestamp_ntz")  # this one reaches the scan
    rows = o.where((F.col("o_orderdate") >= start) & D.within(F.col("day"), "1995-01-01", "1995-06-30") & (F.col("o_orderstatus") == "O"))
    return rows.where(F.lower("o_orderpriority").contains("high")).select("o_orderkey", "day", "o_totalprice")


@query("SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents WHERE lang <> '' GROUP BY lang")
def categories(spark, sf_dir):
    """Distinct categories with the characters that choosing each would take."""
    return _table(spark, sf_dir, "documents").where("lang <> ''").groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


_SPOT_SQL = """
    WITH o AS (
        SELECT user_id || ':' || event_type AS id, CASE event_type WHEN 'click' THEN 'shift' WHEN 'view' THEN 'connection' ELSE 'tension' END AS kind,
            strftime(min(ts), '%Y-%m-%d') AS first_seen_at, strftime(max(ts), '%Y-%m-%d') AS last_seen_at, CAST(count(DISTINCT CAST(ts AS DATE)) AS BIGINT) AS n,
            CASE WHEN max(value) > 100 THEN 'direct' ELSE 'inferred' END AS support
        FROM events GROUP BY user_id, event_type
    ), d AS (
        SELECT *, greatest(0, epoch(TIMESTAMP '2024-02-01' - CAST(last_seen_at AS TIMESTAMP)) / 86400.0) AS age, greatest(0, epoch(TIMESTAMP '2024-02-01' - CAST(first_seen_at AS TIMESTAMP)) / 86400.0) AS since FROM o
    )
    SELECT id, kind, round(greatest(0, 6 - age / 14) + CASE kind WHEN 'shift' THEN 2 WHEN 'connection' THEN 1 ELSE 0 END + least(n, 3) + CASE WHEN since <= 30 THEN 1.5 ELSE 0 END + 1.5
        + CASE WHEN support = 'direct' OR kind = 'shift' THEN 0.5 ELSE 0 END, 6) AS score, last_seen_at
    FROM d WHERE kind = 'shift' OR n >= 2"""


def _observations(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", "shift").when(F.col("event_type") == "view", "connection").otherwise("tension")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    e = _table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(day(F.min("ts")).alias("first_seen_at"), day(F.max("ts")).alias("last_seen_at"), F.countDistinct(F.to_date("ts")).alias("distinct_session_count"), F.when(F.max("value") > 100, "direct").otherwise("inferred").alias("support_type"))
    return e.select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("id"), kind.alias("kind"), "first_seen_at", "last_seen_at", F.col("last_seen_at").alias("detected_at"), "distinct_session_count", "support_type")


@query("SELECT * FROM (" + _SPOT_SQL + ") ORDER BY score DESC, last_seen_at DESC, CASE kind WHEN 'shift' THEN 1 WHEN 'connection' THEN 2 ELSE 3 END, id LIMIT 20")
def spotlight_rank(spark, sf_dir):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    rows = ranking.spotlight(_observations(spark, sf_dir).withColumn("first_seen_at", F.col("first_seen_at")), now, 20)
    return rows.select("id", "kind", F.round("score", 6).alias("score"), "last_seen_at")


@query("SELECT item_id, doc_id FROM benchmark JOIN documents ON contains(documents.text, benchmark.text) WHERE trim(benchmark.text) <> ''")
def quote_grounding(spark, sf_dir):
    """Which documents have which quotes: looked up by hashes of windows, and decided by the characters."""
    q = _table(spark, sf_dir, "benchmark").select("item_id", T.trim(F.col("text")).alias("quote"))
    found = containment.quotes_in(_table(spark, sf_dir, "documents").select("doc_id", "text"), q)
    return found.select(F.col("quote").alias("item_id"), F.col("doc").alias("doc_id"))


_COMPACT = r"regexp_replace(regexp_replace(text, '\s', '', 'g'), '[。、．，]', '', 'g')"
_NEAR_SQL = """
    c AS (SELECT k, min(id) AS id FROM d WHERE k <> '' GROUP BY k)
    SELECT 'equal' AS relation, d.id AS inner_id, c.id AS outer_id FROM d JOIN c USING (k) WHERE d.id <> c.id
    UNION ALL SELECT 'contained', a.id, b.id FROM c a JOIN c b ON length(a.k) < length(b.k) AND contains(b.k, a.k)"""


def _compact(df: DataFrame, id_: Column) -> DataFrame:
    return df.select(id_.alias("id"), T.bare(F.col("text")).alias("k"))


@query(f"WITH d AS (SELECT doc_id AS id, {_COMPACT} AS k FROM documents UNION ALL SELECT -1 - item_id, {_COMPACT} FROM benchmark)," + _NEAR_SQL)
def near_duplicate_text(spark, sf_dir):
    """Texts of two tables that say the same as others or stand in them, as classes and links of classes."""
    d = _compact(_table(spark, sf_dir, "documents"), F.col("doc_id")).unionByName(_compact(_table(spark, sf_dir, "benchmark"), -1 - F.col("item_id")))
    return containment.text_containment(d, "id", "k")


@query(f"WITH d AS (SELECT doc_id AS id, {_COMPACT} AS k FROM documents)," + _NEAR_SQL)
def near_duplicate_documents(spark, sf_dir):
    """The same of whole documents of any length."""
    return containment.text_containment(_compact(_table(spark, sf_dir, "documents"), F.col("doc_id")), "id", "k")


@query("""
    WITH k AS (SELECT min(p_partkey) AS id, lower(replace(p_name, ' ', '')) AS k FROM part GROUP BY ALL)
    SELECT a.id AS inner_id, b.id AS outer_id, a.k AS inner_key, b.k AS outer_key FROM k a JOIN k b ON a.id <> b.id AND contains(b.k, a.k) WHERE length(a.k) >= 2""")
def key_containment(spark, sf_dir):
    k = _table(spark, sf_dir, "part").select("p_partkey", T.concept_key(F.col("p_name")).alias("k")).groupBy("k").agg(F.min("p_partkey").alias("id"))
    return joins.key_containment(k, "id", "k").select("inner_id", "outer_id", "inner_key", "outer_key")


@query("""
    WITH j AS (
        SELECT lang, CASE WHEN n_chars > 2000 THEN 'admit' WHEN n_chars > 500 THEN 'defer' ELSE 'reject' END AS d,
            CASE WHEN l.doc_id IS NULL THEN NULL WHEN quality = 1 AND toxic = 0 THEN 'A' WHEN quality = 1 THEN 'B' WHEN toxic = 0 THEN 'C' ELSE 'D' END AS k
        FROM documents LEFT JOIN labels l USING (doc_id)
    ), c AS (
        SELECT lang, count(k) AS labelled, count(*) FILTER (d = 'admit') AS admitted, count(*) FILTER (d = 'admit' AND k IN ('A', 'B')) AS ab, count(*) FILTER (d = 'admit' AND k IN ('C', 'D')) AS cd,
            count(*) FILTER (k = 'A') AS a, count(*) FILTER (k = 'A' AND d = 'admit') AS aa, count(*) FILTER (k = 'C') AS c, count(*) FILTER (k = 'C' AND d = 'admit') AS ca,
            count(*) FILTER (k = 'D') AS dd, count(*) FILTER (k = 'D' AND d = 'reject') AS dr FROM j GROUP BY lang
    ), r AS (
        SELECT lang, labelled, admitted, aa / nullif(a, 0) AS ra, dr / nullif(dd, 0) AS rd, ab / nullif(ab + cd, 0) AS rab, ca / nullif(c, 0) AS rc, cd / nullif(admitted, 0) AS rf FROM c
    )
    SELECT lang, labelled, admitted, round(ra, 9) AS class_a_admit_rate, round(rd, 9) AS class_d_reject_rate, round(rab, 9) AS admitted_ab_rate, round(rc, 9) AS class_c_admit_rate, round(rf, 9) AS false_admission_rate,
        concat_ws(',', CASE WHEN coalesce(ra, 0) < 0.8 THEN 'class_a_admit_rate' END, CASE WHEN coalesce(rd, 0) < 0.8 THEN 'class_d_reject_rate' END, CASE WHEN coalesce(rab, 0) < 0.75 THEN 'admitted_ab_rate' END,
            CASE WHEN coalesce(rc, 0) > 0.15 THEN 'class_c_admit_rate' END, CASE WHEN coalesce(rf, 0) > 0.25 THEN 'false_admission_rate' END) AS failed
    FROM r""")
def calibration_rates(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels").withColumn("seen", F.lit(True)), "doc_id", "left")
    decision = F.when(F.col("n_chars") > 2000, "admit").when(F.col("n_chars") > 500, "defer").otherwise("reject")
    good, clean = F.col("quality") == 1, F.col("toxic") == 0
    klass = F.when(F.col("seen"), F.when(good & clean, "A").when(good, "B").when(clean, "C").otherwise("D"))
    out = stats.calibration(d.select("lang", decision.alias("decision"), klass.alias("class")), ["lang"])
    rates = [r for r in stats.GOALS if r in out.columns]
    out = out.withColumn("failed", F.array_join(stats.failed_goals(rates), ","))
    return out.select("lang", "labelled", "admitted", *(F.round(r, 9).alias(r) for r in rates), "failed")


_FORMS = admission.FORMS


def _policy_sql(policy: str, rules: str) -> str:
    forms = ", ".join(f"'{x}'" for x in _FORMS)
    hard = " ".join(f"WHEN f = '{k}' THEN 'reject|hard_negative:{k}|{v}'" for k, v in admission.HARD.items())
    return f"""SELECT doc_id, '{policy}' AS policy, string_split(v, '|')[1] AS decision, string_split(v, '|')[2] AS policy_rule, string_split(v, '|')[3] AS reason_code FROM (
        SELECT doc_id, CASE WHEN f = 'generic_head' THEN 'reject|hard_generic|hard_generic' WHEN f = 'unclear' THEN 'defer|form_unclear|form_unclear' {hard} {rules}
            WHEN f IN ('specific_named_concept', 'stable_topic') THEN 'defer|eligible_without_signal|insufficient_positive_signal' ELSE 'reject|default|insufficient_positive_signal' END AS v
        FROM (SELECT doc_id, [{forms}][1 + doc_id % 10] AS f, (doc_id // 10) % 3 = 0 AS high, (doc_id // 30) % 4 = 0 AS central, n_chars % 3 AS sessions, n_chars % 5 = 0 AS exact FROM documents))"""


_ANY = "(f IN ('specific_named_concept', 'stable_topic') AND (high OR central OR sessions >= 2 OR exact))"


@query(" UNION ALL ".join([
    _policy_sql("named_or_high", "WHEN f = 'specific_named_concept' THEN 'admit|form_specific|form_specific' WHEN f = 'stable_topic' AND high THEN 'admit|form_stable_high|form_stable_high'"),
    _policy_sql("topic_plus_signal", f"WHEN {_ANY} THEN 'admit|form_eligible_with_signal|form_eligible_with_signal'"),
    _policy_sql("high_only", "WHEN f IN ('specific_named_concept', 'stable_topic') AND high THEN 'admit|form_eligible_high|form_eligible_high'"),
]))
def policy_decisions(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), n.cast("int") + 1)
    i = F.col("doc_id")
    rows = d.select("doc_id", pick(_FORMS, i % 10).alias("concept_form"), pick(admission.POTENTIALS, F.floor(i / 10) % 3).alias("longitudinal_potential"), pick(admission.ROLES, F.floor(i / 30) % 4).alias("evidence_role"), (F.col("n_chars") % 3).alias("distinct_session_count"), F.when(F.col("n_chars") % 5 == 0, F.array(F.lit("exact"))).otherwise(F.array(F.lit("new"))).alias("match_kinds"))
    parts = [admission.decide(rows, p).select("doc_id", F.lit(p).alias("policy"), "decision", "policy_rule", "reason_code") for p in admission.POLICIES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""
    WITH h AS (
        SELECT p_brand, 'C' || p_partkey AS ref, list_reduce(list_concat([CAST(2166136261 AS BIGINT)], list_transform(string_split('seed:C' || p_partkey, ''), lambda c: CAST(ord(c) AS BIGINT))), lambda a, c: xor(a, c) * 16777619 % 4294967296) AS hash
        FROM part
    ), n AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY hash, ref) AS place, count(*) OVER (PARTITION BY p_brand) AS n FROM h),
    k AS (SELECT *, greatest(1, CAST(floor(n / 6.0 + 0.5) AS BIGINT)) AS k FROM n)
    SELECT p_brand, ref, hash, CAST(place AS INTEGER) AS place, CAST((SELECT min(b) FROM range(1, 100000) t(b) WHERE b * (n // k) + least(b, n % k) >= place) AS INTEGER) AS batch_no FROM k""")
def balanced_batches(spark, sf_dir):
    p = _table(spark, sf_dir, "part").select("p_brand", F.concat(F.lit("C"), F.col("p_partkey").cast("string")).alias("ref"))
    return ranking.balanced_batches(p, ["p_brand"], "ref", "seed").select("p_brand", "ref", "hash", "place", "batch_no")


@query("""
    WITH f AS (SELECT event_type, user_id, ts, event_id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) > 1 AS again FROM events)
    SELECT event_type, CAST(row_number() OVER w AS INTEGER) AS rank, event_id, user_id FROM f WINDOW w AS (PARTITION BY event_type ORDER BY again, ts, event_id) QUALIFY rank <= 2""")
def representative_evidence(spark, sf_dir):
    return ranking.representatives(_table(spark, sf_dir, "events"), ["event_type"], "user_id", ["ts", "event_id"]).select("event_type", "rank", "event_id", "user_id")


@query("""
    WITH f AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_type, user_id, CAST(ts AS DATE) ORDER BY event_id) = 1)
    SELECT event_type, count(*) AS occurrence_count, count(DISTINCT user_id) AS distinct_session_count, strftime(min(ts), '%Y-%m-%d') AS first_seen_at, strftime(max(ts), '%Y-%m-%d') AS last_seen_at FROM f GROUP BY event_type""")
def occurrence_dedup(spark, sf_dir):
    e = _table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    once = ranking.first_occurrence(e, ["event_type", "user_id", "day"], ["event_id"])
    return once.groupBy("event_type").agg(F.count("*").alias("occurrence_count"), F.countDistinct("user_id").alias("distinct_session_count"), F.min("day").alias("first_seen_at"), F.max("day").alias("last_seen_at"))


@query("""
    WITH c AS (
        SELECT lang, count(*) FILTER (quality = 1) AS hard_item_count, count(*) FILTER (quality = 1 AND toxic = 0) AS hard_valid_count, count(*) FILTER (quality = 0) AS interpretation_item_count,
            count(*) FILTER (quality = 0 AND toxic = 0) AS interpretation_valid_count FROM labels JOIN documents USING (doc_id) GROUP BY lang
    )
    SELECT *, round(coalesce(hard_valid_count / nullif(hard_item_count, 0), 0), 9) AS hard_validation_rate, hard_item_count - hard_valid_count AS hard_excluded_count,
        round(coalesce(interpretation_valid_count / nullif(interpretation_item_count, 0), 0), 9) AS interpretation_validation_rate, interpretation_item_count - interpretation_valid_count AS interpretation_excluded_count FROM c""")
def guard_stats(spark, sf_dir):
    d = _table(spark, sf_dir, "labels").join(_table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    items = d.select("lang", F.when(F.col("quality") == 1, "hard").otherwise("interpretation").alias("guard_type"), (F.col("toxic") == 0).alias("semantic_valid"))
    out = stats.guard_stats(items, ["lang"])
    return out.withColumns({c: F.round(c, 9) for c in out.columns if c.endswith("_rate")})


@query("""
    WITH a AS (SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey < 20), b AS (SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN lower(n_name) ELSE n_name END AS n_name, n_regionkey FROM nation WHERE n_nationkey > 3)
    SELECT count(*) FILTER (b.n_nationkey IS NULL) AS only_before, count(*) FILTER (a.n_nationkey IS NULL) AS only_after, count(*) FILTER (a.n_name <> b.n_name) AS n_name_changed, count(*) FILTER (a.n_regionkey <> b.n_regionkey) AS n_regionkey_changed
    FROM a FULL JOIN b ON a.n_nationkey = b.n_nationkey""")
def identity_diff(spark, sf_dir):
    n = _table(spark, sf_dir, "nation")
    after = n.where("n_nationkey > 3").withColumn("n_name", F.when(F.col("n_regionkey") == 1, F.lower("n_name")).otherwise(F.col("n_name")))
    return stats.identity_diff(n.where("n_nationkey < 20"), after, "n_nationkey", ["n_name", "n_regionkey"])


@query("""
    WITH n AS (SELECT o_custkey, count(*) AS n, min(strftime(o_orderdate, '%Y-%m-%d')) AS a, max(strftime(o_orderdate, '%Y-%m-%d')) AS b FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey)
    SELECT c_custkey, c_mktsegment, CAST(coalesce(n, 0) AS BIGINT) AS order_count, a AS first_day, b AS last_day,
        CASE WHEN a = b THEN replace(a, '-', '/') ELSE replace(a, '-', '/') || ' - ' || replace(b, '-', '/') END AS label,
        CASE WHEN n IS NULL THEN 'missing' ELSE 'present' END AS state
    FROM customer LEFT JOIN n ON c_custkey = o_custkey""")
def bridge_joins(spark, sf_dir):
    """Parents with the counts and days of their children, and which have none (by the anti and semi join)."""
    o = _table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    c = _table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    state = joins.missing(c, o, ["c_custkey"]).withColumn("state", F.lit("missing")).unionByName(joins.present(c, o, ["c_custkey"]).withColumn("state", F.lit("present")))
    n = stats.date_span(o, ["c_custkey"], "day").join(o.groupBy("c_custkey").agg(F.count("*").alias("order_count")), "c_custkey")
    return state.join(n, "c_custkey", "left").withColumn("order_count", F.coalesce("order_count", F.lit(0).cast("long")))


@query("""
    WITH RECURSIVE up(conv, node, depth) AS (
        SELECT conv_id, max(turn), 0 FROM conversations GROUP BY conv_id
        UNION ALL SELECT up.conv, c.turn, up.depth + 1 FROM up JOIN conversations c ON c.conv_id = up.conv AND c.turn = up.node - 1
    ) SELECT conv, node, CAST(depth AS INTEGER) AS depth FROM up""")
def branch_recursive(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations")
    last = c.groupBy("conv_id").agg(F.max("turn").alias("last"))
    edges = c.join(last, "conv_id").select(F.col("conv_id").alias("conv"), F.col("turn").alias("node"), (F.col("turn") - 1).alias("parent"), (F.col("turn") == F.col("last")).alias("is_current"))
    return export.branch_by_joins(edges)


@query("""
    SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS week_start, strftime(date_trunc('week', o_orderdate) + INTERVAL 6 DAY, '%Y-%m-%d') AS week_end,
        strftime(date_trunc('week', o_orderdate) - INTERVAL 7 DAY, '%Y-%m-%d') AS last_week_start, strftime(o_orderdate - INTERVAL 29 DAY, '%Y-%m-%d') AS last_30_start, strftime(o_orderdate, '%Y/%m/%d') AS label FROM orders""")
def ranges(spark, sf_dir):
    d = _table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    week, before, month = D.week_range(F.col("d")), D.week_range(F.col("d"), 1), D.last_days(F.col("d"), 30)
    day = F.date_format("d", "yyyy-MM-dd")
    return d.select(day.alias("day"), week["start"].alias("week_start"), week["end"].alias("week_end"), before["start"].alias("last_week_start"), month["start"].alias("last_30_start"), D.slashed(day).alias("label"))


@query("""
    WITH f AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS again FROM events),
    s AS (SELECT *, sum(CASE WHEN again = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS slot FROM f)
    SELECT event_id, CASE WHEN again = 1 AND slot <= 3 THEN CAST(slot AS BIGINT) END AS slot, CASE WHEN again > 1 THEN 'duplicate' WHEN slot > 3 THEN 'over_limit' END AS reason FROM s""")
def distinct_slots(spark, sf_dir):
    return ranking.first_distinct(_table(spark, sf_dir, "events"), ["user_id"], "event_type", ["ts", "event_id"]).select("event_id", "slot", "reason")


@query("""
    WITH n(reason) AS (VALUES ('O'), ('F'), ('P'), ('X')), c AS (SELECT o_orderstatus AS reason, count(*) AS n FROM orders GROUP BY 1)
    SELECT reason, CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM n LEFT JOIN c USING (reason)""")
def reason_histogram(spark, sf_dir):
    h = stats.reason_histogram(_table(spark, sf_dir, "orders"), [], "o_orderstatus")
    return stats.zero_filled(h, ["O", "F", "P", "X"], "reason", "n")


@query("""
    WITH a AS (
        SELECT conv_id, turn, lower(regexp_extract(text, '^\\s*(\\S+)', 1)) AS raw FROM conversations WHERE role = 'user'
    ), f AS (SELECT * FROM a WHERE raw <> '')
    SELECT conv_id, turn, 'virtual:' || raw AS concept_id, printf('C%02d', dense_rank() OVER (PARTITION BY conv_id ORDER BY first_turn)) AS concept_ref, CASE WHEN turn = first_turn THEN 'new' ELSE 'match' END AS resolved_as
    FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id, raw) AS first_turn FROM f)""".replace("\\\\", "\\"))
def concept_identities(spark, sf_dir):
    """The first word of each user message as a concept of its conversation."""
    m = _table(spark, sf_dir, "conversations").where("role = 'user'").withColumn("label", F.lower(F.regexp_extract("text", r"^\s*(\S+)", 1))).where("label <> ''")
    null = F.lit(None).cast("string")
    a = m.select("conv_id", F.col("turn").alias("pos"), F.col("turn").alias("batch_no"), F.lit("S").alias("session_id"), F.format_string("M%03d:E01", "turn").alias("evidence_ref"), F.lit("new").alias("action"), F.col("label").alias("surface_form"), null.alias("existing_ref"), null.alias("ground_reason"))
    return concepts.resolve(a, ["conv_id"]).select("conv_id", F.col("pos").alias("turn"), "concept_id", "concept_ref", "resolved_as")


@query("""
    SELECT c_nationkey, c_custkey, c_acctbal, CAST(row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS rank FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5""")
def recent_list(spark, sf_dir):
    """The first five of an ordered list."""
    best = _table(spark, sf_dir, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(5)
    return best.select("c_nationkey", "c_custkey", "c_acctbal", F.row_number().over(Window.orderBy(F.desc("c_acctbal"), "c_custkey")).alias("rank"))


_JUDGED_SQL = """
    WITH j AS (
        SELECT doc_id, lang, source, CASE WHEN n_chars > 2000 THEN 'admit' WHEN n_chars > 500 THEN 'defer' ELSE 'reject' END AS d,
            CASE WHEN n_chars > 2000 THEN 'stable_topic' WHEN n_chars > 500 THEN 'insufficient_context' WHEN doc_id % 2 = 0 THEN 'generic' ELSE 'clause' END AS r FROM documents
    )"""


def _judged(spark, sf_dir):
    n = F.col("n_chars")
    d = _table(spark, sf_dir, "documents")
    decision = F.when(n > 2000, "admit").when(n > 500, "defer").otherwise("reject")
    reason = F.when(n > 2000, "stable_topic").when(n > 500, "insufficient_context").when(F.col("doc_id") % 2 == 0, "generic").otherwise("clause")
    return d.select("doc_id", decision.alias("decision"), reason.alias("reason_code"), F.array("lang", "source").alias("session_ids"))


@query(_JUDGED_SQL + " SELECT count(*) AS total_candidates, count(*) FILTER (d = 'admit') AS admitted, count(*) FILTER (d = 'defer') AS deferred, count(*) FILTER (d = 'reject') AS rejected, " + ", ".join(f"count(*) FILTER (r = '{r}') AS reason_{r}" for k in ("admit", "reject", "defer") for r in admission.REASONS[k]) + " FROM j")
def admission_totals(spark, sf_dir):
    return admission.report_totals(_judged(spark, sf_dir))


@query(_JUDGED_SQL + """, s AS (SELECT d, unnest([lang, source]) AS session_id FROM j)
    SELECT session_id, count(*) AS candidate_count, count(*) FILTER (d = 'admit') AS admitted_count, count(*) FILTER (d = 'defer') AS deferred_count, count(*) FILTER (d = 'reject') AS rejected_count FROM s GROUP BY session_id""")
def admission_sessions(spark, sf_dir):
    return admission.report_sessions(_judged(spark, sf_dir))


_REVIEW_SQL = """
    WITH c AS (SELECT DISTINCT conv_id FROM conversations), s AS (
        SELECT conv_id // 20 AS review_id, conv_id, row_number() OVER (PARTITION BY conv_id // 20 ORDER BY conv_id) AS n, 'Conversation ' || conv_id AS title, printf('2024-01-%02d', 1 + conv_id % 28) AS day FROM c
    )"""


def _reviews(spark, sf_dir):
    i = F.col("conv_id")
    c = _table(spark, sf_dir, "conversations").select("conv_id").distinct()
    c = c.select(F.floor(i / 20).alias("review_id"), "conv_id", F.concat(F.lit("Conversation "), i.cast("string")).alias("title"), F.format_string("2024-01-%02d", 1 + i % 28).alias("occurred_at"))
    return c.withColumn("session_no", F.row_number().over(Window.partitionBy("review_id").orderBy("conv_id")))


@query(_REVIEW_SQL + """, m AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role IN ('user', 'assistant')
    ), b AS (
        SELECT review_id, n, string_agg('[' || printf('S%02d:M%03d:E01', n, k) || '][' || upper(role) || ']' || chr(10) || text || chr(10), chr(10) ORDER BY k) AS body, any_value(title) AS title, any_value(day) AS day
        FROM s JOIN m USING (conv_id) GROUP BY review_id, n
    )
    SELECT review_id, rtrim(string_agg(repeat('=', 20) || chr(10) || 'SESSION ' || printf('S%02d', n) || chr(10) || repeat('=', 11) || chr(10) || chr(10) || 'Title:' || chr(10) || title || chr(10) || chr(10) || 'Date:' || chr(10)
        || replace(day, '-', '/') || chr(10) || chr(10) || body, chr(10) ORDER BY n), ' ' || chr(10)) AS transcript, count(*) AS session_count FROM b GROUP BY review_id""")
def review_transcripts(spark, sf_dir):
    """The conversations of each review as one labelled text; here a message is one unit."""
    s = _reviews(spark, sf_dir)
    m = units.numbered_messages(_table(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant")), ["conv_id"], ["turn"])
    u = m.join(s.select("review_id", "session_no", "conv_id"), "conv_id").select("review_id", "session_no", "message_no", F.lit(1).alias("unit_no"), F.format_string("S%02d:M%03d:E01", "session_no", "message_no").alias("ref"), "role", F.col("text").alias("unit_text"))
    return units.review_transcript(s, u)


@query(_REVIEW_SQL + """, e AS (SELECT review_id, min(n) AS a, max(n) AS b FROM s GROUP BY review_id)
    SELECT review_id, '最も新しいSessionは ' || printf('S%02d', y.n) || '（' || replace(y.day, '-', '/') || ' / ' || y.title || '）。'
        || CASE WHEN a <> b THEN chr(10) || '最も古いSessionは ' || printf('S%02d', x.n) || '（' || replace(x.day, '-', '/') || ' / ' || x.title || '）。' ELSE '' END AS note
    FROM e JOIN s x USING (review_id) JOIN s y USING (review_id) WHERE x.n = a AND y.n = b""")
def review_context_notes(spark, sf_dir):
    return units.context_note(_reviews(spark, sf_dir))


@query("""
    WITH c AS (SELECT lang, count(*) AS total, count(*) FILTER (quality = 1) AS valid FROM documents JOIN labels USING (doc_id) GROUP BY lang)
    SELECT lang, '根拠 ' || valid || '/' || total || '（' || CAST(floor(valid / total * 100 + 0.5) AS BIGINT) || '%）' AS evidence, '横断解釈 ' || valid || '/' || total || '（' || CAST(floor(valid / total * 100 + 0.5) AS BIGINT) || '%）' AS interpretation, total - valid AS excluded FROM c""")
def metric_labels(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", "lang").join(_table(spark, sf_dir, "labels"), "doc_id")
    c = d.groupBy("lang").agg(F.count("*").alias("total"), F.count_if(F.col("quality") == 1).alias("valid"))
    v, t, none = F.col("valid"), F.col("total"), F.lit(None)
    return c.select("lang", L.evidence_metric(v, t, v / t).alias("evidence"), L.interpretation_metric(v, t, none).alias("interpretation"), L.hard_excluded(none, t, v).alias("excluded"))
