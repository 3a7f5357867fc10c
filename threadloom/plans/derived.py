"""More queries: operators of reviews, concepts and observations over rows derived from the test tables, with SQL that gives the same rows.

The tables have no reviews or annotations, so these are made from the conversations by fixed rules, in Spark and in SQL alike: 20
conversations are a review, each is a session with a day, each user message makes a claim that begins with one of TERMS and cites messages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import text as T
from ..operators import evidence as E
from ..operators import findings, guards, joins, lists, ranking, sessions, stats, units
from ..shared import kept, shared_dir
from ..sources import export, payloads, sinks, transcript
from . import admission, analysis, concepts, context_pack, observations, pilot, review
from .queries import _reviews, _table, query

#: Beginnings of claims: each brings about another rule. The one at ALONE stands without a text.
TERMS = ["", "顧客獲得 ", "恐れている ", "ユーザーは昨日それに気づいた ", "劇的 ", "AI活用", "次のレベルへ進める ", "今後どう進めるか", "田中さん ", "A vs B "]
ALONE = (5, 7)
DAY = "printf('2024-01-%02d', 1 + {0} % 28)"


def _term(i: Column, terms: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, terms)), (i % len(terms)).cast("int") + 1)


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


def _day(i: Column) -> Column:
    return F.format_string("2024-01-%02d", 1 + i % 28)


def _messages(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant"))


_CLAIMS = f"""
    m AS (SELECT conv_id, turn, role, text FROM conversations WHERE role IN ('user', 'assistant')),
    c AS (SELECT conv_id, turn, text, (conv_id * 7 + turn) % {len(TERMS)} AS t FROM m WHERE role = 'user'),
    i AS (SELECT conv_id, turn, {_sql_list(TERMS)}[t + 1] || CASE WHEN t IN {ALONE} THEN '' ELSE text END AS claim FROM c)"""
_CITED = (
    _CLAIMS
    + f""",
    e0 AS (
        SELECT i.conv_id, i.turn, m.conv_id AS s, m.turn AS k, m.role, m.text AS quote FROM i JOIN m ON m.conv_id = i.conv_id AND m.turn BETWEEN i.turn - 1 AND i.turn
        UNION ALL SELECT i.conv_id, i.turn, m.conv_id, m.turn, m.role, m.text FROM i JOIN m ON m.conv_id = i.conv_id + 1 AND m.turn = i.turn WHERE (i.conv_id + i.turn) % 3 <> 0
    ), e AS (SELECT *, {DAY.format("s")} AS day, (s * 31 + k) % 5 <> 0 AS ok, CASE WHEN k % 2 = 0 THEN 'quote_not_found' ELSE 'empty_quote' END AS why FROM e0),
    a AS (
        SELECT i.conv_id, i.turn, claim, coalesce(bool_or(NOT ok AND why = 'quote_not_found'), false) AS invalid, count(DISTINCT CASE WHEN ok THEN s END) AS n, coalesce(bool_or(ok), false) AS valid,
            coalesce(bool_or(ok AND role = 'user'), false) AS usr, coalesce(string_agg(quote, chr(10)) FILTER (ok), '') AS corpus, count(s) AS n_all, count(s) FILTER (ok) AS n_ok
        FROM i LEFT JOIN e USING (conv_id, turn) GROUP BY ALL
    )"""
).replace("GROUP BY ALL", "GROUP BY i.conv_id, i.turn, claim")


def _claims(spark, sf_dir) -> DataFrame:
    m = _messages(spark, sf_dir).where("role = 'user'")
    t = F.col("conv_id") * 7 + F.col("turn")
    return m.select("conv_id", "turn", F.concat(_term(t, TERMS), F.when((t % len(TERMS)).isin(*ALONE), "").otherwise(F.col("text"))).alias("claim"))


def _cited(spark, sf_dir) -> DataFrame:
    """Claims with their evidence."""
    m = _messages(spark, sf_dir)
    cite = m.select(F.col("conv_id").alias("s"), F.col("turn").alias("k"), "role", "text")
    i = _claims(spark, sf_dir)
    own = i.join(cite, (F.col("s") == F.col("conv_id")) & F.col("k").between(F.col("turn") - 1, F.col("turn")))
    far = i.where((F.col("conv_id") + F.col("turn")) % 3 != 0).join(cite, (F.col("s") == F.col("conv_id") + 1) & (F.col("k") == F.col("turn")))
    ok = (F.col("s") * 31 + F.col("k")) % 5 != 0
    null = F.lit(None).cast("string")
    ev = F.struct(
        F.format_string("S%02d:M%03d:E01", "s", "k").alias("message_ref"), F.col("text").alias("quote"), ok.alias("validated"), F.when(~ok, F.when(F.col("k") % 2 == 0, "quote_not_found").otherwise("empty_quote")).alias("reason"), "role",
        F.concat_ws(":", F.col("s").cast("string"), F.col("k").cast("string")).alias("message_id"), F.col("s").cast("string").alias("session_id"), _day(F.col("s")).alias("occurred_at"),
    )
    lists_ = own.unionByName(far).groupBy("conv_id", "turn").agg(F.transform(F.array_sort(F.collect_list(F.struct("s", "k", ev.alias("e")))), lambda x: x["e"]).alias("evidence"))
    return i.join(lists_, ["conv_id", "turn"], "left").withColumn("evidence", F.coalesce("evidence", F.array().cast(f"array<{E.EVIDENCE}>")))


def _any(column: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{t}')" for t in terms) + ")"


_LEAP = "(" + " OR ".join(f"(contains(claim, '{t}') AND NOT contains(corpus, '{t}'))" for t in T.LEAP_TERMS) + ")"
_ROLE = "CASE WHEN valid THEN 'evidence_role_mismatch' ELSE 'missing_user_evidence' END"
_HARD = f"WHEN {_LEAP} THEN 'domain_leap|hard' WHEN regexp_matches(claim, '{T.INNER_STATE}') AND NOT usr THEN {_ROLE} || '|hard'"
_GENERIC = f"regexp_replace(regexp_replace(claim, '\\s', '', 'g'), '[。．]', '', 'g') IN ({', '.join(repr(x) for x in T.GENERIC_THEMES)})"
_SOFT = f"WHEN regexp_matches(claim, '{T.PSYCHOLOGICAL}') THEN 'unrelated_interpretation|interpretation' WHEN {_GENERIC} THEN 'generic_interpretation|interpretation'"
_BAD = "WHEN invalid THEN 'invalid_evidence_ref|hard'"
_THEME = f"CASE {_BAD} WHEN n < 2 THEN 'insufficient_distinct_sessions|hard' {_HARD} {_SOFT} ELSE '|interpretation' END"
_TENSION = f"CASE {_BAD} {_HARD} WHEN n < 2 THEN 'insufficient_distinct_sessions|interpretation' {_SOFT} ELSE '|interpretation' END"
_HYPOTHESIS = f"CASE {_BAD} {_HARD} WHEN n < 2 THEN 'insufficient_distinct_sessions|interpretation' {_SOFT} WHEN {_any('claim', T.EXAGGERATIONS)} OR {_any('claim', T.UNVERIFIABLE)} THEN 'unsupported_exaggeration|interpretation' ELSE '|interpretation' END"
_NEXT = f"CASE {_BAD} WHEN trim(claim) = '' OR regexp_matches(trim(claim), '{T.WEAK_QUESTIONS}') THEN 'weak_next_question|interpretation' ELSE '|interpretation' END"


def _said(verdict: Column) -> Column:
    return F.concat(F.coalesce(verdict["reason"], F.lit("")), F.lit("|"), verdict["guard_type"])


@query(f"WITH {_CITED} SELECT conv_id, turn, {_THEME} AS theme, {_TENSION} AS insight, {_HYPOTHESIS} AS hypothesis, CASE {_BAD} ELSE '|interpretation' END AS open_question, {_NEXT} AS next_question FROM a")
def guard_verdicts(spark, sf_dir):
    """What each guard says of each claim: reason and type."""
    c, ev = F.col("claim"), F.col("evidence")
    rules = {"theme": guards.theme(c, ev), "insight": guards.tension(c, ev), "hypothesis": guards.hypothesis(c, ev), "open_question": guards.open_question(ev), "next_question": guards.next_question(c, ev)}
    return _cited(spark, sf_dir).select("conv_id", "turn", *(_said(v).alias(k) for k, v in rules.items()))


_SIDES = f"""WITH {_CITED}, o AS (
        SELECT conv_id, turn, bool_or(NOT ok AND why = 'quote_not_found') AS invalid, list_sort(list(DISTINCT s) FILTER (ok)) AS ss, min(CASE WHEN ok THEN day END) AS day, coalesce(bool_or(ok), false) AS valid, coalesce(bool_or(ok AND role = 'user'), false) AS usr
        FROM e GROUP BY conv_id, turn
    ), p AS (
        SELECT x.conv_id, x.turn, x.invalid OR y.invalid AS invalid, coalesce(x.ss, []) AS sa, coalesce(y.ss, []) AS sb, x.day AS da, y.day AS db, x.valid AND y.valid AS valid, x.usr AND y.usr AS usr FROM o x JOIN o y ON y.conv_id = x.conv_id + 1 AND y.turn = x.turn
    )
    SELECT conv_id, turn, CASE WHEN invalid THEN 'invalid_evidence_ref' WHEN len(sa) = 0 OR len(sb) = 0 THEN 'insufficient_distinct_sessions' WHEN len(sa) = 1 AND len(sb) = 1 AND sa = sb THEN 'unsupported_cross_session_claim'
            WHEN da > db OR da = db AND list_min(sa) >= list_min(sb) THEN 'invalid_chronology' WHEN NOT usr THEN {_ROLE} ELSE '' END || '|hard' AS shift,
        CASE WHEN invalid THEN 'invalid_evidence_ref|hard' WHEN len(sa) = 1 AND len(sb) = 1 AND sa = sb THEN 'insufficient_distinct_sessions|interpretation' ELSE 'other' END AS sides
    FROM p"""


@query(_SIDES)
def shift_verdicts(spark, sf_dir):
    """Shifts from the evidence of a claim to that of the same turn a conversation later, and tensions between the two."""
    a = _cited(spark, sf_dir).where(F.size("evidence") > 0)
    b = a.select((F.col("conv_id") - 1).alias("conv_id"), "turn", F.col("evidence").alias("after"))
    rows = a.join(b, ["conv_id", "turn"])
    order = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: (F.col("conv_id") + i).cast("string"))
    shift = guards.shift(F.col("evidence"), F.col("after"), order)
    none = F.array().cast(f"array<{E.EVIDENCE}>")
    sides = _said(guards.tension(F.lit("x"), none, F.col("evidence"), F.col("after")))
    invalid = E.has_invalid_ref(F.col("evidence")) | E.has_invalid_ref(F.col("after"))
    one = guards._one_session(F.col("evidence"), F.col("after"))
    return rows.select("conv_id", "turn", _said(shift).alias("shift"), F.when(invalid | one, sides).otherwise("other").alias("sides"))


_KINDS = ["fact", "insight", "hypothesis", "decision", "action", "open_question"]
_SUBJECTS = ["user", "conversation", "interpretation", "external"]
_ALLOWED = " OR ".join(f"(kind = '{k}' AND subject IN ({', '.join(repr(x) for x in v)}))" for k, v in E.SUBJECTS.items())
_SUPPORTED = f"""k AS (SELECT *, {_sql_list(_KINDS)}[1 + (conv_id + turn) % 6] AS kind, {_sql_list(_SUBJECTS)}[1 + conv_id % 4] AS subject FROM a),
    j AS (
        SELECT *, CASE WHEN NOT ({_ALLOWED}) THEN 'unsupported_subject_kind' WHEN invalid THEN 'invalid_evidence_ref' WHEN (kind IN ('decision', 'action') OR kind IN ('fact', 'insight') AND subject = 'user') AND NOT usr THEN {_ROLE} END AS invalid_reason,
            CASE WHEN kind = 'fact' THEN NOT valid WHEN kind IN ('decision', 'action') THEN NOT usr ELSE false END AS unsupported_claim FROM k
    )"""


def _supported(spark, sf_dir) -> DataFrame:
    i = F.col("conv_id")
    rows = _cited(spark, sf_dir).withColumns({"kind": _term(i + F.col("turn"), _KINDS), "subject": _term(i, _SUBJECTS)})
    reason = E.support_reason(F.col("kind"), F.col("subject"), F.col("evidence"))
    return rows.withColumns({"invalid_reason": reason, "semantic_valid": reason.isNull(), "unsupported_claim": E.unsupported_claim(F.col("kind"), F.col("evidence"))})


@query(f"""WITH {_CITED}, {_SUPPORTED} SELECT conv_id, turn, kind, subject, invalid_reason, unsupported_claim, CAST(list_position({_sql_list(analysis.KINDS)}, kind) AS BIGINT) AS kind_rank, kind = 'insight' AND subject = 'interpretation' AS interpretive,
    invalid_reason IS NULL AS shown FROM j""")
def support_reasons(spark, sf_dir):
    """Whether the evidence supports each claim as an item of some kind and subject, and how a page shows it."""
    s = _supported(spark, sf_dir)
    seen = analysis.shown(s).select("conv_id", "turn", F.lit(True).alias("seen"))
    all_ = analysis.shown(s.withColumn("semantic_valid", F.lit(None).cast("boolean")))
    return all_.join(seen, ["conv_id", "turn"], "left").select("conv_id", "turn", "kind", "subject", "invalid_reason", "unsupported_claim", F.col("kind_rank").cast("long").alias("kind_rank"), "interpretive", F.coalesce("seen", F.lit(False)).alias("shown"))


@query(f"""WITH {_CITED}, {_SUPPORTED}, s AS (SELECT conv_id, CAST(sum(n_all) AS BIGINT) AS evidence_count, CAST(sum(n_ok) AS BIGINT) AS validated_count, count(*) AS semantic_item_count, count(*) FILTER (invalid_reason IS NULL) AS semantic_valid_count FROM j GROUP BY conv_id)
    SELECT *, round(CASE WHEN evidence_count > 0 THEN validated_count / evidence_count ELSE 0 END, 9) AS validation_rate, round(semantic_valid_count / semantic_item_count, 9) AS semantic_validation_rate FROM s""")
def analysis_metrics(spark, sf_dir):
    m = analysis.metrics(_supported(spark, sf_dir), ["conv_id"])
    return m.withColumns({c: F.round(c, 9) for c in ("validation_rate", "semantic_validation_rate")})


_SECTIONED = f"""{_CITED}, r0 AS (SELECT *, conv_id // 20 AS review_id, CASE WHEN turn % 4 < 2 THEN 'themes' ELSE 'insights' END AS section FROM a),
    r1 AS (SELECT *, CAST(row_number() OVER (PARTITION BY review_id, section ORDER BY conv_id, turn) AS INTEGER) - 1 AS pos FROM r0), r2 AS (SELECT *, CASE section WHEN 'themes' THEN {_THEME} ELSE {_TENSION} END AS v FROM r1 WHERE pos < 3),
    r3 AS (SELECT *, regexp_replace(regexp_replace(claim, '\\s', '', 'g'), '[。、．，]', '', 'g') AS k FROM r2),
    r4 AS (SELECT x.*, EXISTS (SELECT 1 FROM r3 y WHERE y.review_id = x.review_id AND x.section = 'insights' AND y.section = 'themes' AND y.v LIKE '|%' AND y.k <> '' AND x.k <> '' AND (contains(x.k, y.k) OR contains(y.k, x.k))) AS dup FROM r3 x),
    r5 AS (SELECT *, CASE WHEN dup THEN 'duplicate_interpretation|interpretation' ELSE v END AS w FROM r4), r6 AS (SELECT *, nullif(string_split(w, '|')[1], '') AS reason, string_split(w, '|')[2] AS guard FROM r5)"""


def _sectioned(spark, sf_dir) -> DataFrame:
    from pyspark.sql import Window

    rows = _cited(spark, sf_dir).withColumns({"review_id": F.floor(F.col("conv_id") / 20), "section": F.when(F.col("turn") % 4 < 2, "themes").otherwise("insights")})
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("review_id", "section").orderBy("conv_id", "turn")) - 1)
    none = F.lit(None).cast(f"array<{E.EVIDENCE}>")
    rows = rows.select("review_id", "section", "pos", F.col("claim").alias("text"), "evidence", *(none.alias(c) for c in ("side_a", "side_b", "before", "after")))
    sess = _reviews(spark, sf_dir).select("review_id", F.col("conv_id").cast("string").alias("session_id"), "session_no")
    return review.judge(rows, sess)


@query(f"WITH {_SECTIONED} SELECT review_id, section, pos, reason AS invalid_reason, guard AS guard_type, CAST(n AS INTEGER) AS distinct_session_count FROM r6")
def review_judged(spark, sf_dir):
    """Items of reviews within the limits of their section, judged; insights that repeat a theme are refused."""
    return _sectioned(spark, sf_dir).select("review_id", "section", "pos", "invalid_reason", "guard_type", "distinct_session_count")


@query(f"""WITH {_SECTIONED}, g AS (
        SELECT review_id, CAST(sum(n_all) AS BIGINT) AS ev, CAST(sum(n_ok) AS BIGINT) AS evv, count(*) FILTER (guard = 'hard') AS h, count(*) FILTER (guard = 'hard' AND reason IS NULL) AS hv, count(*) FILTER (guard = 'interpretation') AS p, count(*) FILTER (guard = 'interpretation' AND reason IS NULL) AS pv,
            count(*) FILTER (section = 'themes' AND reason IS NULL) + count(*) FILTER (section = 'insights' AND reason IS NULL) > 0 AS level2 FROM r6 GROUP BY review_id
    )
    SELECT review_id, false AS level1, level2, false AS level3, concat_ws(' · ', CASE WHEN ev > 0 THEN '根拠 ' || evv || '/' || ev || '（' || CAST(floor(evv / ev * 100 + 0.5) AS BIGINT) || '%）' END,
        '横断解釈 ' || pv || '/' || p || '（' || CAST(floor(CASE WHEN p = 0 THEN 0 ELSE pv / p END * 100 + 0.5) AS BIGINT) || '%）', 'Hard Guard除外 ' || (h - hv) || '件') AS quality FROM g""")
def review_levels(spark, sf_dir):
    judged = kept(_sectioned(spark, sf_dir), "judged")
    return review.levels(judged).join(review.quality_line(review.metrics(judged)), "review_id")


@query(f"WITH {_SECTIONED} SELECT review_id, section, count(*) FILTER (reason IS NULL) AS visible, count(*) FILTER (reason IS NOT NULL AND guard = 'hard') AS hidden_hard, count(*) FILTER (reason IS NOT NULL AND guard <> 'hard') AS hidden_interpretation FROM r6 GROUP BY review_id, section")
def review_shown(spark, sf_dir):
    return review.shown(_sectioned(spark, sf_dir))


@query(f"WITH {_SECTIONED} SELECT review_id, section, CAST(count(*) AS BIGINT) AS n, CAST(sum(length(quote)) AS BIGINT) AS chars, count(*) FILTER (ok) AS validated FROM r6 JOIN e USING (conv_id, turn) GROUP BY review_id, section")
def review_evidence_rows(spark, sf_dir):
    """What is stored of the evidence of judged items."""
    e = review.evidence_rows(_sectioned(spark, sf_dir))
    return e.groupBy("review_id", "section").agg(F.count("*").alias("n"), F.sum(F.length("quote")).alias("chars"), F.count_if("validated").alias("validated"))


@query("SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN 'empty_quote' WHEN turn % 5 = 3 THEN 'invalid_message_ref' WHEN turn % 5 = 2 THEN 'quote_not_found' END AS reason, turn % 5 < 2 AS validated FROM conversations")
def quote_evidence(spark, sf_dir):
    """Quotes of messages: right ones, changed ones, blank ones, and of messages that aren't there."""
    m = _table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("message_ref"), F.col("text").alias("content"))
    t = F.col("message_ref")
    q = m.select("conv_id", t.alias("turn"), F.when(t % 5 == 3, -1 - t).otherwise(t).alias("message_ref"), F.when(t % 5 == 4, " 　").when(t % 5 == 2, F.concat("content", F.lit("?!"))).when(t % 5 == 1, F.concat(F.lit(" "), "content", F.lit("\n"))).otherwise(F.col("content")).alias("quote"))
    return E.check_quotes(q, m, ["conv_id"]).select("conv_id", "turn", "reason", "validated")


# Units, by recursion in SQL: from the end of one, past white space, to the first break at least 20 characters on.
_UNITS = r"""
    um AS (SELECT conv_id, turn, lower(trim(role)) AS role, text, length(text) AS n, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS message_no FROM conversations WHERE lower(trim(role)) IN ('user', 'assistant')),
    ub AS (
        SELECT *, list_transform(list_filter(range(1, n + 1), lambda p: text[p] IN (chr(10), '。', '！', '？', '!', '?') OR text[p] = '.' AND NOT (regexp_matches(text[p - 1], '^[0-9]$') AND regexp_matches(text[p + 1], '^[0-9]$'))),
            lambda p: p + CASE WHEN text[p] IN ('.', '!', '?') THEN length(regexp_extract(substr(text, p + 1), '^ *')) ELSE 0 END) AS ends FROM um
    ), ur(conv_id, turn, role, text, n, message_no, ends, unit_no, a, b) AS (
        SELECT conv_id, turn, role, text, n, message_no, ends, 0, 0, 0 FROM ub
        UNION ALL SELECT conv_id, turn, role, text, n, message_no, ends, unit_no + 1, s, coalesce(list_min(list_filter(ends, lambda x: x >= s + 20)), n)
        FROM (SELECT *, b + length(regexp_extract(substr(text, b + 1), '^\s*')) AS s FROM ur) WHERE s < n
    ), u AS (
        SELECT conv_id, turn, role, message_no, unit_no, printf('M%03d:E%02d', message_no, unit_no) AS ref, regexp_replace(substr(text, a + 1, b - a), '\s+$', '') AS unit_text, CAST(a AS INTEGER) AS unit_start FROM ur WHERE unit_no > 0
    )"""


@query(f"WITH RECURSIVE {_UNITS} SELECT conv_id, turn, ref, unit_text, unit_start, CAST(unit_start + length(unit_text) AS INTEGER) AS unit_end FROM u WHERE role = 'user'")
def evidence_units(spark, sf_dir):
    """Units of the users' messages."""
    u = units.evidence_units(_table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], content="text", roles=("user",))
    return u.select("conv_id", "turn", "ref", "unit_text", "unit_start", "unit_end")


@query(f"WITH RECURSIVE {_UNITS} SELECT conv_id, role, count(*) AS n_units, CAST(sum(length(unit_text)) AS BIGINT) AS chars, count(DISTINCT message_no) AS n_messages FROM u GROUP BY conv_id, role")
def unit_stats(spark, sf_dir):
    u = units.evidence_units(_table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], content="text")
    return u.groupBy("conv_id", "role").agg(F.count("*").alias("n_units"), F.sum(F.length("unit_text")).alias("chars"), F.countDistinct("message_no").alias("n_messages"))


@query(f"""WITH RECURSIVE {_UNITS}, b AS (SELECT conv_id, message_no, '[' || upper(any_value(role)) || ' MESSAGE ' || printf('M%03d', message_no) || ']' || chr(10) || chr(10) || string_agg('[' || ref || '][' || upper(role) || ']' || chr(10) || unit_text, chr(10) || chr(10) ORDER BY unit_no) AS t FROM u GROUP BY conv_id, message_no),
    f AS (SELECT conv_id, string_agg(t, chr(10) || chr(10) ORDER BY message_no) AS transcript FROM b GROUP BY conv_id),
    g AS (SELECT conv_id, string_agg('[S1:' || printf('M%03d', message_no) || '][' || upper(role) || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY message_no) AS plain, count(*) AS k FROM um GROUP BY conv_id),
    h AS (SELECT conv_id, string_agg('[' || ref || '][USER] ' || unit_text, chr(10) || chr(10) ORDER BY message_no, unit_no) AS units_text FROM u WHERE role = 'user' GROUP BY conv_id)
    SELECT conv_id, transcript, plain, units_text, CASE WHEN k = 0 THEN 'no_messages' WHEN length(transcript) > 40000 THEN 'too_long' END AS reason FROM g JOIN f USING (conv_id) LEFT JOIN h USING (conv_id)""")
def annotator_texts(spark, sf_dir):
    """What annotators read of each conversation, in three forms, and whether it can be analysed."""
    c = _table(spark, sf_dir, "conversations").withColumnRenamed("text", "content")
    m = units.numbered_messages(c, ["conv_id"], ["turn"])
    u = kept(units.evidence_units(c, ["conv_id"], ["turn"]), "units")
    whole = analysis.can_analyse(units.labelled_transcript(m, u, ["conv_id"]))
    plain = units.plain_transcript(m, ["conv_id"]).withColumnRenamed("transcript", "plain")
    return whole.join(plain, "conv_id").join(units.user_units_text(u.where("role = 'user'"), ["conv_id"]), "conv_id", "left").select("conv_id", "transcript", "plain", "units_text", "reason")


@query(f"""WITH RECURSIVE {_UNITS}, q AS (SELECT conv_id, turn, 1 AS item_id, unnest([ref, 'M999:E01', 'M00' || (turn % 3) || ':E01']) AS r, generate_subscripts([1, 2, 3], 1) AS place, turn AS t FROM u WHERE unit_no = 1)
    SELECT q.conv_id, q.turn, place, CASE WHEN u.ref IS NULL THEN 'invalid_evidence_ref' END AS reason, coalesce(u.unit_text, '') AS quote FROM q LEFT JOIN u ON u.conv_id = q.conv_id AND u.ref = q.r""")
def resolved_refs(spark, sf_dir):
    """Refs of units: right ones, unknown ones, and ones of the first messages that may not be there."""
    c = _table(spark, sf_dir, "conversations").withColumn("message_id", F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    u = kept(units.evidence_units(c, ["conv_id"], ["turn"], content="text"), "units")
    items = u.where("unit_no = 1").select("conv_id", F.col("turn").alias("item_id"), F.array("ref", F.lit("M999:E01"), F.concat(F.lit("M00"), (F.col("turn") % 3).cast("string"), F.lit(":E01"))).alias("refs"))
    got = E.resolve_refs(items, u, c.withColumnRenamed("text", "content"), ["conv_id"])
    flat = got.select("conv_id", F.col("item_id").alias("turn"), F.posexplode("evidence").alias("place", "e"))
    return flat.select("conv_id", "turn", (F.col("place") + 1).cast("long").alias("place"), "e.reason", "e.quote")


_LABELS = ["今日", "田中さん", "A vs B", "プレゼントや", "気持ち", "高性能", "論理的", "散歩すること", "皆さん", "設計したい欲求について", "りんご", "短い。", "", "今後確認する", "みんなが言うのに"]
_KEY = "regexp_replace(x, '\\s', '', 'g')"
_HONOR = "len(list_filter(regexp_extract_all(x, '([^\\s、。，]{1,12}(さん|くん|ちゃん|様))', 1), lambda v: v NOT IN ('皆さん', 'みなさん'))) > 0"
_LONG = "(length(x) > 16 OR regexp_matches(x, '[。！？]') OR regexp_matches(x, '(のに|こと)$') AND length(x) > 8)"
_EPISODE = f"(regexp_matches(x, '{T.EPISODIC}') OR {_HONOR} AND regexp_matches(x, '{T.EPISODIC_WITH_PERSON}'))"
_DENIED = f"{_KEY} IN ({', '.join(repr(v) for v in T.DENIED_CONCEPTS)})"
_COMPOUND = "regexp_matches(x, '[×↔⇔]|(?i:(^|\\s)vs(\\s|$))|[\\p{Han}\\p{Katakana}A-Za-z0-9]{2,}と[\\p{Han}\\p{Katakana}A-Za-z0-9]{2,}')"


@query(f"""WITH l AS (SELECT doc_id, {_sql_list(_LABELS)}[1 + doc_id % {len(_LABELS)}] || CASE WHEN doc_id % 2 = 0 THEN '' ELSE text END AS x, lang FROM documents)
    SELECT doc_id, CASE WHEN {_KEY} = '' THEN 'empty' WHEN {_DENIED} THEN 'generic_term' WHEN {_COMPOUND} THEN 'compound_relation' END AS candidate,
        CASE WHEN {_KEY} = '' THEN 'empty' WHEN {_DENIED} THEN 'generic_term' WHEN {_HONOR} THEN 'honorific_person' WHEN {_EPISODE} THEN 'episodic_phrase' WHEN {_LONG} THEN 'long_clause' WHEN length(x) > 8 AND length(x) > length(lang) * 2 THEN 'too_divergent' END AS alias,
        regexp_matches(x, '(さん|くん|ちゃん|様)$') AND x NOT IN ('皆さん', 'みなさん') AS honorific, {_KEY} IN ({', '.join(repr(v) for v in T.BROAD_SURFACES)}) AS broad, {_KEY} IN ({', '.join(repr(v) for v in T.GENERIC_SURFACES)}) AS generic_surface, {_KEY} IN ({', '.join(repr(v) for v in T.ADJECTIVES)}) AS adjective,
        {_LONG} OR length(x) >= 5 AND suffix(x, 'こと') OR length(x) >= 8 AND suffix(x, '欲求') OR length(x) >= 6 AND regexp_matches(x, '{T.CLAUSE_TAIL}') AS clause_like, {_KEY} = '' OR {_KEY} IN ({', '.join(repr(v) for v in T.VAGUE_IDEAS)}) AS vague, substr(trim(regexp_replace(x, '\\s+', ' ', 'g')), 1, 80) AS short
    FROM l""")
def label_rules(spark, sf_dir):
    """The rules of concept labels on given labels, alone or before a whole text."""
    d = _table(spark, sf_dir, "documents")
    x = F.col("x")
    rows = d.select("doc_id", "lang", F.concat(_term(F.col("doc_id"), _LABELS), F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.col("text"))).alias("x"))
    return rows.select(
        "doc_id", T.candidate_reason(x).alias("candidate"), T.alias_reason(x, F.col("lang")).alias("alias"), T.is_honorific(x).alias("honorific"), T.is_broad(x).alias("broad"), T.is_generic_surface(x).alias("generic_surface"), T.is_adjective(x).alias("adjective"),
        T.is_clause_like(x).alias("clause_like"), T.is_vague_idea(x).alias("vague"), T.shorten(x).alias("short"),
    )


_BIGRAMS = "CASE WHEN length({0}) > 1 THEN list_transform(range(1, length({0})), lambda i: substr({0}, i, 2)) ELSE [] END"


@query(f"""WITH p AS (SELECT p_partkey, p_name, p_type, lower(replace(p_name, ' ', '')) AS a, lower(replace(p_type, ' ', '')) AS b, lower(replace(p_name, ' ', '') || replace(p_type, ' ', '')) AS ab FROM part)
    SELECT p_partkey, NOT contains(a, b) AND NOT contains(b, a) AND (greatest(length(p_name), length(p_type)) >= 4 AND greatest(length(p_name), length(p_type)) >= least(length(p_name), length(p_type)) * 1.8 OR NOT list_has_any({_BIGRAMS.format("a")}, {_BIGRAMS.format("b")})) AS divergent,
        length(ab) - length(b) >= 2 AS over_general, contains(a, b) OR contains(b, a) AS near FROM p""")
def label_divergence(spark, sf_dir):
    """How far names of parts are from their types, and whether a name with its type says more than the type."""
    p = _table(spark, sf_dir, "part")
    n, t = F.col("p_name"), F.col("p_type")
    return p.select("p_partkey", T.is_divergent(n, t).alias("divergent"), T.is_over_general(F.concat(n, t), t).alias("over_general"), T.near_duplicates(F.lower(n), F.lower(t)).alias("near"))


@query(f"""WITH m AS (SELECT conv_id, turn, role, text FROM conversations), c AS (SELECT conv_id, min(turn) AS first FROM m GROUP BY conv_id)
    SELECT m.conv_id, m.turn, m.role, CASE WHEN role IN ('user', 'assistant') THEN text END AS content, role NOT IN ('user', 'assistant') AS skipped, 'Conversation ' || m.conv_id AS title, CAST(m.conv_id AS DOUBLE) AS created FROM m""")
def export_messages(spark, sf_dir):
    """Conversations written as exports with a dead end after each message, and read back along their live branch."""
    c = _table(spark, sf_dir, "conversations")
    node = lambda id_, parent, role, text: F.struct(id_.alias("id"), parent.alias("parent"), F.struct(id_.alias("id"), F.struct(role.alias("role")).alias("author"), F.struct(F.lit("text").alias("content_type"), F.array(text).alias("parts")).alias("content")).alias("message"))
    t = F.col("turn").cast("string")
    before = F.lag(t).over(_window(["conv_id"], ["turn"]))
    rows = c.withColumn("before", before).select("conv_id", "turn", F.explode(F.array(node(t, F.col("before"), F.col("role"), F.col("text")), node(F.concat(t, F.lit("x")), t, F.lit("assistant"), F.lit("dead end")))).alias("n"))
    convs = rows.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("n.id", "n"))).alias("mapping"), F.max("turn").cast("string").alias("current_node"))
    whole = F.to_json(F.struct(F.col("conv_id").cast("string").alias("conversation_id"), F.concat(F.lit(" Conversation "), F.col("conv_id").cast("string")).alias("title"), F.col("conv_id").cast("double").alias("create_time"), "mapping", "current_node"))
    found = export.conversations(convs.select(F.col("conv_id").cast("string").alias("external_id"), F.parse_json(whole).alias("c")))
    m = export.visible_messages(export.live_branch(found)).join(found.select("external_id", "title", "created").withColumnRenamed("created", "conv_created"), "external_id")
    return m.select(F.col("external_id").cast("long").alias("conv_id"), F.col("source_message_id").cast("long").alias("turn"), "role", F.when(~F.col("skipped"), F.col("content")).alias("content"), "skipped", "title", F.col("conv_created").alias("created"))


def _window(keys: list[str], order: list[str]):
    from pyspark.sql import Window

    return Window.partitionBy(*keys).orderBy(*order)


_PASTED = """
    p0 AS (
        SELECT conv_id, turn, role, text, length(text) AS n, CAST(row_number() OVER w AS INTEGER) - 1 AS index, lead(turn) OVER w IS NULL AS last, CASE role WHEN 'user' THEN 6 ELSE 11 END + length(text) + CASE WHEN row_number() OVER w > 1 THEN 2 ELSE 0 END AS size
        FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
    ), p1 AS (SELECT *, CAST(sum(size) OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS stop FROM p0),
    p AS (SELECT conv_id, index, role, text || CASE WHEN last THEN '' ELSE chr(10) || chr(10) END AS content, CAST(stop - n AS INTEGER) AS char_start, CAST(stop + CASE WHEN last THEN 0 ELSE 2 END AS INTEGER) AS char_end FROM p1)"""


def _pasted(spark, sf_dir) -> DataFrame:
    m = _messages(spark, sf_dir)
    return sessions.transcripts(m, ["conv_id"], ["turn"], content="text").select(F.col("conv_id").alias("session_id"), "raw_content")


@query(f"WITH {_PASTED} SELECT conv_id, index, role, content, char_start, char_end FROM p")
def pasted_messages(spark, sf_dir):
    """Conversations as pasted text, cut into messages again."""
    rows = _pasted(spark, sf_dir).select(F.col("session_id").alias("conv_id"), "raw_content", F.inline(transcript.messages_of("raw_content")))
    broken = sessions.broken_anchors(rows, "raw_content", "char_start", "char_end", "content")  # there are none
    return rows.join(broken.select("conv_id").distinct(), "conv_id", "left_anti").select("conv_id", "index", "role", "content", "char_start", "char_end")


@query(f"""WITH {_PASTED}, n AS (SELECT count(DISTINCT conv_id) AS c, count(*) AS m FROM p)
    SELECT unnest(['first', 'second', 'reparsed', 'deleted']) AS run, unnest([c, 0, 0, 0]) AS conversations, unnest([c, 0, c, 0]) AS sessions, unnest([m, 0, m, 0]) AS messages, unnest([0, c, 0, 0]) AS already_imported FROM n""")
def imported_once(spark, sf_dir):
    """An import that is repeated adds nothing; sessions parsed again have their messages replaced; a cascade takes all."""
    root = f"{shared_dir(spark)}/import-{spark.sql('SELECT uuid()').first()[0]}"
    texts = _pasted(spark, sf_dir)
    status, lines = sinks.parsed_sessions(texts)
    s = status.where("status = 'parsed'").select("session_id", F.lit("export").alias("source"), F.col("session_id").cast("string").alias("external_id"), "status")
    c = s.select("source", "external_id")
    done = [sinks.import_conversations(c, s, lines.select("session_id", "index", "role", "content"), root) for _ in range(2)]
    sinks.replace_partitions(lines.withColumn("bucket", F.col("session_id") % 8), f"{root}/again", "bucket")
    again = spark.read.parquet(f"{root}/again")
    left = sinks.delete_keys(again, s, ["session_id"])
    count = lambda name, df: df.agg(F.lit(name).alias("run"), F.lit(0).cast("long").alias("conversations"), F.countDistinct("session_id").alias("sessions"), F.count("*").alias("messages"), F.lit(0).cast("long").alias("already_imported"))
    runs = [(name, d["conversations"], d["sessions"], d["messages"], d["already_imported"]) for name, d in zip(("first", "second"), done, strict=True)]
    told = spark.createDataFrame(runs, "run string, conversations long, sessions long, messages long, already_imported long")
    return told.unionByName(count("reparsed", again)).unionByName(count("deleted", left))


_OBS = f"""
    i AS (SELECT conv_id, conv_id // 20 AS review_id, conv_id % 3 AS sec, arg_min(text, turn) AS text FROM conversations GROUP BY conv_id),
    o AS (SELECT *, row_number() OVER (PARTITION BY review_id, sec ORDER BY conv_id) AS pos FROM i), d AS (SELECT DISTINCT conv_id FROM conversations),
    v AS (
        SELECT review_id, {_sql_list(["SHIFT", "INSIGHT", "TENSION"])}[sec + 1] AS word, {_sql_list(["shift", "connection", "tension"])}[sec + 1] AS kind, pos, trim(text) AS title, o.conv_id, {DAY.format("o.conv_id")} AS own, d.conv_id IS NOT NULL AS there, {DAY.format("(o.conv_id + 1)")} AS far
        FROM o LEFT JOIN d ON d.conv_id = o.conv_id + 1 WHERE o.conv_id % 7 <> 0 AND review_id % 4 <> 3
    ), r AS (
        SELECT review_id, printf('R:%s:%02d', word, pos) AS source_ref, kind, title, least(own, CASE WHEN there THEN far ELSE own END) AS first_seen_at, greatest(own, CASE WHEN there THEN far ELSE own END) AS last_seen_at, [CAST(conv_id AS VARCHAR), CAST(conv_id + 1 AS VARCHAR)] AS ids FROM v
    )"""


def _review_rows(spark, sf_dir) -> DataFrame:
    """Reviews with an item for each conversation; of each fourth the version is too old."""
    i = F.col("conv_id")
    c = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    ev = lambda *ids: F.array(*(F.struct(x.cast("string").alias("session_id"), F.lit(None).cast("string").alias("occurred_at")) for x in ids))
    null = F.lit(None).cast("array<struct<session_id:string,occurred_at:string>>")
    item = F.struct(F.col("text").alias("text"), F.when(i % 3 == 0, F.concat(F.lit(" "), "text")).alias("interpretation"), F.when(i % 7 == 0, False).when(i % 5 == 0, None).otherwise(True).alias("semantic_valid"), F.lit("direct").alias("support_type"), F.lit(None).cast("int").alias("distinct_session_count"), F.when(i % 3 != 0, ev(i)).alias("evidence"), F.when(i % 3 == 0, ev(i)).alias("before_evidence"), F.when(i % 3 == 0, ev(i + 1)).alias("after_evidence"), F.when(i % 3 != 0, ev(i + 1)).alias("side_a_evidence"), null.alias("side_b_evidence"))
    of = lambda k: F.transform(F.filter(F.array_sort(F.collect_list(F.struct("conv_id", item.alias("i")))), lambda x: x["conv_id"] % 3 == k), lambda x: x["i"])
    r = c.groupBy(F.floor(i / 20).alias("review_id")).agg(of(0).alias("shifts"), of(1).alias("cross_insights"), of(2).alias("tensions"))
    return r.withColumns({"prompt_version": F.when(F.col("review_id") % 4 == 3, "old").otherwise(observations.PROJECTABLE[0]), "detected_at": F.lit("2024-02-01")})


def _session_days(spark, sf_dir) -> DataFrame:
    i = F.col("conv_id")
    return _table(spark, sf_dir, "conversations").select("conv_id").distinct().select(i.cast("string").alias("session_id"), _day(i).alias("occurred_at"), F.concat(F.lit("Conversation "), i.cast("string")).alias("title"))


@query(f"WITH {_OBS} SELECT review_id, source_ref, kind, title, first_seen_at, last_seen_at, array_to_string(ids, ',') AS session_ids, CAST(2 AS INTEGER) AS distinct_session_count FROM r")
def observation_projection(spark, sf_dir):
    """Observations of the visible items of reviews whose version projects."""
    p = observations.project(_review_rows(spark, sf_dir), _session_days(spark, sf_dir))
    return p.select("review_id", "source_ref", "kind", "title", "first_seen_at", "last_seen_at", F.array_join("session_ids", ",").alias("session_ids"), "distinct_session_count")


@query(f"""WITH {_OBS}, n AS (SELECT (SELECT count(*) FROM r) AS k, count(DISTINCT review_id) AS considered, count(DISTINCT review_id) FILTER (review_id % 4 <> 3) AS projected, count(DISTINCT review_id) FILTER (review_id % 4 = 3) AS skipped FROM o)
    SELECT considered, projected, skipped, k AS inserted, 0 AS inserted_again, k AS skipped_existing FROM n""")
def observation_backfill(spark, sf_dir):
    """A backfill and its repetition."""
    r = kept(_review_rows(spark, sf_dir), "reviews")
    p = observations.project(r, _session_days(spark, sf_dir))
    path = f"{shared_dir(spark)}/observations-{spark.sql('SELECT uuid()').first()[0]}"
    n = [sinks.insert_if_absent(p, path, observations.IDENTITY) for _ in range(2)]
    counts = observations.backfill_counts(r, p, sinks.existing(spark, path, p))
    return counts.select("considered", "projected", "skipped", F.lit(n[0]).cast("long").alias("inserted"), F.lit(n[1]).alias("inserted_again"), "skipped_existing")


@query(f"""WITH {_OBS}, x AS (SELECT *, review_id || '/' || source_ref || '/review-observation-v1' AS id FROM r), y AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY last_seen_at DESC, id) AS k FROM x)
    SELECT id, kind, CASE kind WHEN 'shift' THEN '変化' WHEN 'connection' THEN '接続' ELSE '緊張関係' END AS kind_label, title, last_seen_at AS thought_date, 'Review ' || review_id AS review_title,
        concat_ws(',', CASE WHEN a.conv_id IS NOT NULL THEN 'Conversation ' || ids[1] END, CASE WHEN b.conv_id IS NOT NULL THEN 'Conversation ' || ids[2] END) AS sessions
    FROM y LEFT JOIN d a ON a.conv_id = CAST(ids[1] AS BIGINT) LEFT JOIN d b ON b.conv_id = CAST(ids[2] AS BIGINT) WHERE k <= 5""")
def home_cards(spark, sf_dir):
    """The cards of a home page: stored observations, parsed, the latest five of each kind."""
    p = observations.project(_review_rows(spark, sf_dir), _session_days(spark, sf_dir))
    shift = F.col("kind") == "shift"
    payload = F.when(shift, F.to_json(F.struct(F.col("title").alias("interpretation"), F.lit("b").alias("before"), F.lit("a").alias("after")))).otherwise(F.to_json(F.struct(F.col("title").alias("text"))))
    hidden = p.limit(1).withColumns({"payload": F.lit('{"text":"x","semanticValid":false}'), "kind": F.lit("tension"), "source_ref": F.lit("R:HIDDEN:01"), "last_seen_at": F.lit("2099-01-01")})
    records = p.withColumn("payload", payload).unionByName(hidden)
    i = F.col("review_id")
    titles = _review_rows(spark, sf_dir).select("review_id", F.concat(F.lit("Review "), i.cast("string")).alias("title"))
    cards = observations.cards(observations.home(observations.from_records(records), _session_days(spark, sf_dir), titles))
    return cards.select("id", "kind", "kind_label", "title", "thought_date", "review_title", F.array_join(F.transform("sessions", lambda s: s["title"]), ",").alias("sessions"))


@query(f"""WITH {_OBS}, s AS (
        SELECT *, review_id || '/' || source_ref || '/review-observation-v1' AS id, greatest(0, 6 - date_diff('day', CAST(last_seen_at AS DATE), DATE '2024-02-01') / 14.0) + CASE kind WHEN 'shift' THEN 2 WHEN 'connection' THEN 1 ELSE 0 END + 2
            + CASE WHEN date_diff('day', CAST(first_seen_at AS DATE), DATE '2024-02-01') <= 30 THEN 1.5 ELSE 0 END + 1.5 + 0.5 AS score FROM r
    ) SELECT id, title FROM s ORDER BY score DESC, last_seen_at DESC, CASE kind WHEN 'shift' THEN 1 WHEN 'connection' THEN 2 ELSE 3 END, id LIMIT 1""")
def home_spotlight(spark, sf_dir):
    """The one observation that a home page shows first."""
    p = observations.project(_review_rows(spark, sf_dir), _session_days(spark, sf_dir)).withColumn("item", F.lit(None).cast(observations._PAYLOAD))
    titles = _review_rows(spark, sf_dir).select("review_id", F.lit("r").alias("title"))
    return observations.home_model(p, _session_days(spark, sf_dir), titles, F.lit("2024-02-01 00:00:00").cast("timestamp")).where("spotlight").select("id", "title")


# Concepts: each unit of a user is annotated with its first words as new concepts or matches; some units are skipped.
_ACTIONS = f"""{_UNITS}, s AS (SELECT conv_id // 20 AS owner, conv_id, {DAY.format("conv_id")} AS day, ref, message_no, unit_no, unit_text, (conv_id * 5 + message_no * 3 + unit_no) % 10 AS t FROM u WHERE role = 'user'),
    w AS (SELECT *, CASE WHEN t = 0 THEN 'skip' WHEN t = 1 THEN 'uncertain' ELSE 'new' END AS action, CASE WHEN t < 2 THEN '' WHEN t = 2 THEN unit_text || '?!' ELSE regexp_extract(unit_text, '^\\S+') END AS surface FROM s),
    k AS (SELECT *, translate(surface, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key, CASE WHEN t = 2 THEN 'surface_not_in_unit' END AS ground FROM w),
    f AS (SELECT *, t > 2 AND ground IS NULL AS ok FROM k), b AS (SELECT owner, key, min((day, CAST(conv_id AS VARCHAR), message_no * 1000 + unit_no)) AS first FROM f WHERE ok GROUP BY owner, key),
    g AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY first) AS nr FROM b),
    z AS (SELECT f.*, g.nr, (f.day, CAST(f.conv_id AS VARCHAR), f.message_no * 1000 + f.unit_no) AS spot, first FROM f LEFT JOIN g ON f.ok AND g.owner = f.owner AND g.key = f.key)"""


def _annotated(spark, sf_dir):
    """Messages, sessions and their annotation, for the pilot."""
    i = F.col("conv_id")
    c = _table(spark, sf_dir, "conversations").select(F.floor(i / 20).alias("owner"), i.cast("string").alias("session_id"), "conv_id", "turn", "role", F.col("text").alias("content"))
    days = c.select("owner", "session_id", "conv_id").distinct().select("owner", "session_id", _day(i).alias("occurred_at"))
    u = units.evidence_units(c, ["owner", "session_id"], ["turn"], roles=("user",))
    t = (i * 5 + F.col("message_no") * 3 + F.col("unit_no")) % 10
    surface = F.when(t == 2, F.concat("unit_text", F.lit("?!"))).otherwise(F.regexp_extract("unit_text", r"^\S+", 0))
    one = F.array(F.struct(F.lit("new").alias("action"), surface.alias("surface_form"), F.lit(None).cast("string").alias("existing_ref")))
    none = F.array().cast("array<struct<action:string,surface_form:string,existing_ref:string>>")
    said = F.when(t == 0, "skip").when(t == 1, "uncertain").otherwise("extracted")
    notes = u.select("owner", "session_id", F.col("ref").alias("evidence_ref"), (F.col("message_no") * 1000 + F.col("unit_no")).alias("pos"), said.alias("disposition"), F.when(t < 2, none).otherwise(one).alias("concepts"))
    return c.drop("conv_id"), days, notes


@query(f"""WITH RECURSIVE {_ACTIONS} SELECT owner, CAST(conv_id AS VARCHAR) AS session_id, ref AS evidence_ref, CASE WHEN t < 2 THEN action WHEN ok THEN 'accepted' ELSE 'rejected' END AS status, CASE WHEN ok THEN printf('C%02d', nr) END AS concept_ref,
    CASE WHEN ok THEN CASE WHEN first.v2 = CAST(conv_id AS VARCHAR) THEN 'new' ELSE 'match' END END AS resolved_as, CASE WHEN ok AND spot > first THEN 'exact' END AS match_kind, ground AS reason FROM (SELECT * REPLACE ({{'v1': first[1], 'v2': first[2]}} AS first), first AS f0 FROM z) q""".replace("spot > first", "spot > f0"))
def concept_outcomes(spark, sf_dir):
    """What becomes of each action of an annotator of concepts."""
    p = pilot.run(*_annotated(spark, sf_dir))
    return p.outcomes.select("owner", "session_id", "evidence_ref", "status", "concept_ref", "resolved_as", "match_kind", "reason")


@query(f"""WITH RECURSIVE {_ACTIONS}, n AS (SELECT owner, count(*) AS processed_units, count(*) FILTER (t = 0) AS skip, count(*) FILTER (t = 1) AS uncertain, count(*) FILTER (t = 2) AS rejected, count(*) FILTER (ok) AS occurrences, count(DISTINCT CASE WHEN ok THEN key END) AS unique_concepts FROM z GROUP BY owner)
    SELECT *, CAST(0 AS BIGINT) AS failed_sessions, unique_concepts AS new, CAST(0 AS BIGINT) AS provisional_match FROM n""")
def pilot_totals(spark, sf_dir):
    """Totals of the concept pilot of each owner."""
    return pilot.totals(pilot.run(*_annotated(spark, sf_dir))).drop("match")


@query(f"""WITH RECURSIVE {_ACTIONS}, o AS (SELECT owner || ':' || printf('C%02d', nr) AS ref, conv_id, day, ref AS unit, unit_text, row_number() OVER (PARTITION BY owner, nr, conv_id ORDER BY day, ref) AS again FROM z WHERE ok)
    SELECT ref, count(*) AS occurrence_count, count(DISTINCT conv_id) AS distinct_session_count, min(day) AS first_seen_at, max(day) AS last_seen_at, array_to_string(list_sort(list(DISTINCT CAST(conv_id AS VARCHAR))), ',') AS session_ids,
        array_to_string(list(unit ORDER BY day, unit, CAST(conv_id AS VARCHAR)), ',') AS evidence_refs, array_to_string(list_slice(list(unit ORDER BY again > 1, day, unit, CAST(conv_id AS VARCHAR)), 1, 2), ',') AS shown FROM o GROUP BY ref""")
def admission_candidates(spark, sf_dir):
    """Concepts as candidates for admission, with their occurrences and the units that represent them."""
    c = pilot.run(*_annotated(spark, sf_dir)).candidates
    return c.select("ref", "occurrence_count", "distinct_session_count", "first_seen_at", "last_seen_at", F.array_join("session_ids", ",").alias("session_ids"), F.array_join("evidence_refs", ",").alias("evidence_refs"), F.array_join(F.transform("representative_evidence", lambda e: e["evidence_ref"]), ",").alias("shown"))


_LABEL = "regexp_extract(unit_text, '^\\\\S+')".replace("\\\\", "\\")
_FOUND = f"""WITH RECURSIVE {_ACTIONS}, c AS (SELECT owner, owner || ':' || printf('C%02d', nr) AS ref, arg_min(surface, spot) AS x, any_value(key) AS key, count(DISTINCT (conv_id, ref)) AS n FROM z WHERE ok GROUP BY owner, nr)"""


@query(_FOUND + """
    SELECT 'singleton_new' AS kind, ref AS concept_ref, NULL AS other_ref FROM c WHERE n <= 1 UNION ALL SELECT 'long_label', ref, NULL FROM c WHERE length(x) > 12
    UNION ALL SELECT DISTINCT 'normalized_key_containment', least(a.ref, b.ref), greatest(a.ref, b.ref) FROM c a JOIN c b ON a.owner = b.owner AND a.ref <> b.ref AND contains(b.key, a.key) WHERE length(a.key) >= 2
    UNION ALL SELECT 'clause_like', ref, NULL FROM c WHERE length(x) > 16 OR regexp_matches(x, '[。！？]')""")
def concept_findings(spark, sf_dir):
    """Findings about the concepts of the pilot, of the kinds that these texts can bring about."""
    f = pilot.run(*_annotated(spark, sf_dir)).findings
    return f.where(F.col("kind").isin("singleton_new", "long_label", "normalized_key_containment", "clause_like")).select("kind", "concept_ref", "other_ref")


@query("""WITH e AS (SELECT DISTINCT conv_id, turn FROM conversations WHERE role = 'user'), n AS (SELECT conv_id, turn AS pos, turn FROM e WHERE (conv_id + turn) % 7 <> 0 UNION ALL SELECT conv_id, 1000, -5 FROM e WHERE conv_id % 5 = 0 GROUP BY conv_id UNION ALL SELECT conv_id, 900, min(turn) FROM e WHERE conv_id % 3 = 0 GROUP BY conv_id),
    x AS (SELECT n.*, e.turn IS NOT NULL AS known, row_number() OVER (PARTITION BY n.conv_id, n.turn ORDER BY pos) > 1 AS again FROM n LEFT JOIN e USING (conv_id, turn)),
    b AS (SELECT conv_id, arg_min((CASE WHEN NOT known THEN 'unknown_evidence_ref' ELSE 'duplicate_evidence_ref' END, CAST(turn AS VARCHAR)), pos) AS f FROM x WHERE NOT known OR again GROUP BY conv_id),
    g AS (SELECT e.conv_id, array_to_string(list_sort(list(CAST(e.turn AS VARCHAR))), ',') AS d FROM e ANTI JOIN n ON n.conv_id = e.conv_id AND n.turn = e.turn WHERE e.conv_id NOT IN (SELECT conv_id FROM b) GROUP BY e.conv_id)
    SELECT conv_id, f[1] AS reason, f[2] AS detail FROM b UNION ALL SELECT conv_id, 'missing_unit', d FROM g""")
def extraction_coverage(spark, sf_dir):
    """The first thing wrong with an annotation of user messages: unknown, repeated or missing refs."""
    e = _table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn").distinct()
    n = e.where((F.col("conv_id") + F.col("turn")) % 7 != 0).select("conv_id", F.col("turn").alias("pos"), "turn")
    n = n.unionByName(e.where("conv_id % 5 = 0").select("conv_id").distinct().select("conv_id", F.lit(1000).alias("pos"), F.lit(-5).alias("turn"))).unionByName(e.where("conv_id % 3 = 0").groupBy("conv_id").agg(F.lit(900).alias("pos"), F.min("turn").alias("turn")))
    text = F.col("turn").cast("string").alias("evidence_ref")
    notes = n.select("conv_id", "pos", text, F.lit("skip").alias("disposition"), F.array().cast("array<struct<action:string,surface_form:string,existing_ref:string>>").alias("concepts"))
    return concepts.coverage(e.select("conv_id", text), notes, ["conv_id"])


@query("""WITH x AS (SELECT event_id, user_id, event_type, event_id % 9 AS k, ts FROM events)
    SELECT event_id, CASE k WHEN 1 THEN 'missing_concept_id' WHEN 2 THEN 'missing_session_id' WHEN 3 THEN 'missing_message_id' WHEN 4 THEN 'missing_occurred_at' WHEN 5 THEN 'invalid_evidence_ref' WHEN 6 THEN 'non_user_source_role' WHEN 7 THEN 'unsupported_source_type' WHEN 8 THEN 'unsupported_extraction_version' END AS reason FROM x""")
def occurrence_checks(spark, sf_dir):
    """Occurrences with one fault each, or none."""
    k = F.col("event_id") % 9
    bad = lambda n, wrong, right: F.when(k == n, wrong).otherwise(right)
    rows = _table(spark, sf_dir, "events").select(
        "event_id", bad(1, " ", "c").alias("concept_id"), bad(2, "", F.col("user_id").cast("string")).alias("session_id"), bad(3, None, "m").alias("message_id"), bad(4, "", "2024-01-01").alias("occurred_at"), bad(5, "M1", "M001:E02").alias("evidence_ref"), bad(6, "assistant", "user").alias("source_role"),
        bad(7, "quote", concepts.SOURCE_TYPE).alias("source_type"), bad(8, "v0", concepts.EXTRACTION_VERSION).alias("extraction_version"),
    )
    return rows.select("event_id", concepts.occurrence_reason().alias("reason"))


@query("""WITH j AS (SELECT CASE WHEN n_chars > 2000 THEN 'admit' WHEN n_chars > 500 THEN 'defer' ELSE 'reject' END AS d, CASE WHEN l.doc_id IS NULL THEN NULL WHEN quality = 1 AND toxic = 0 THEN 'A' WHEN quality = 1 THEN 'B' WHEN toxic = 0 THEN 'C' ELSE 'D' END AS k FROM documents LEFT JOIN labels l USING (doc_id)),
    c AS (SELECT count(*) FILTER (d = 'admit' AND k IN ('A', 'B')) AS ab, count(*) FILTER (d = 'admit' AND k IN ('C', 'D')) AS cd, count(*) FILTER (k = 'A') AS a, count(*) FILTER (k = 'A' AND d = 'admit') AS aa, count(*) FILTER (k = 'D') AS x, count(*) FILTER (k = 'D' AND d = 'reject') AS dr FROM j)
    SELECT round(ab / nullif(ab + cd, 0), 9) AS admitted_ab_share, round(cd / nullif(ab + cd, 0), 9) AS admitted_cd_share, round(aa / nullif(a, 0), 9) AS class_a_admit_rate, round(dr / nullif(x, 0), 9) AS class_d_reject_rate FROM c""")
def calibration_shares(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels").withColumn("seen", F.lit(True)), "doc_id", "left")
    decision = F.when(F.col("n_chars") > 2000, "admit").when(F.col("n_chars") > 500, "defer").otherwise("reject")
    good, clean = F.col("quality") == 1, F.col("toxic") == 0
    out = admission.shares(d.select(decision.alias("decision"), F.when(F.col("seen"), F.when(good & clean, "A").when(good, "B").when(clean, "C").otherwise("D")).alias("class")))
    return out.select(*(F.round(c, 9).alias(c) for c in out.columns))


_CANDS = """
    c AS (SELECT 'C' || c_custkey AS ref, c_mktsegment AS label, c_custkey FROM customer),
    e AS (SELECT 'C' || o_custkey AS ref, CAST(o_orderkey AS VARCHAR) AS session_id, 'M001:E01' AS unit, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE ' ' || o_orderpriority || '  x ' END AS text, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders QUALIFY n <= 2),
    r AS (SELECT ref, count(*) FILTER (text IS NOT NULL) AS k, string_agg(trim(regexp_replace(text, '\\s+', ' ', 'g')), '|' ORDER BY n) FILTER (text IS NOT NULL) AS texts FROM e GROUP BY ref)"""


def _cands(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("ref"), F.col("o_orderkey").cast("string").alias("session_id"), "o_orderkey", "o_orderdate", "o_orderpriority")
    two = ranking.top_n(o, ["ref"], [F.asc("o_orderdate"), F.asc("o_orderkey")], 2)
    ev = F.struct("session_id", F.lit("M001:E01").alias("evidence_ref"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("occurred_at"), F.lit("").alias("short_text"))
    rep = two.groupBy("ref").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", ev.alias("e")))), lambda x: x["e"]).alias("representative_evidence"))
    cust = _table(spark, sf_dir, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("ref"), F.col("c_custkey").alias("pos"), F.col("c_mktsegment").alias("canonical_label"))
    cands = cust.join(rep, "ref", "left").withColumn("representative_evidence", F.coalesce("representative_evidence", F.array().cast("array<struct<session_id:string,evidence_ref:string,occurred_at:string,short_text:string>>")))
    texts = o.where("o_orderkey % 3 <> 0").select("session_id", F.lit("M001:E01").alias("evidence_ref"), F.concat(F.lit(" "), "o_orderpriority", F.lit("  x ")).alias("text"))
    return cands, texts


@query(f"WITH {_CANDS} SELECT c.ref, coalesce(k, 0) > 0 AS evidence_resolved, coalesce(texts, '') AS texts FROM c LEFT JOIN r USING (ref)")
def evidence_resolution(spark, sf_dir):
    """Candidates with the evidence whose unit has a text."""
    got = admission.resolved_evidence(*_cands(spark, sf_dir))
    return got.select("ref", "evidence_resolved", F.array_join(F.transform("representative_evidence", lambda e: e["short_text"]), "|").alias("texts"))


@query(f"WITH {_CANDS} SELECT count(*) AS total_candidates, count(*) FILTER (k > 0) AS resolved_candidates, count(*) FILTER (coalesce(k, 0) = 0) AS unresolved_candidates FROM c LEFT JOIN r USING (ref)")
def evidence_integrity(spark, sf_dir):
    return admission.evidence_integrity(admission.resolved_evidence(*_cands(spark, sf_dir)))


@query(f"""WITH {_CANDS} SELECT c.ref, '## ' || c.ref || chr(10) || 'canonicalLabel: ' || label || chr(10) || 'representativeEvidence:' || chr(10)
    || coalesce(list_aggregate(list_transform(string_split(texts, '|'), lambda x, i: 'Evidence ' || chr(CAST(64 + i AS INTEGER)) || ':' || chr(10) || x), 'string_agg', chr(10) || chr(10)), '- （なし）') AS text FROM c LEFT JOIN r USING (ref)""")
def assessment_texts(spark, sf_dir):
    """What an annotator of assessments reads of each candidate."""
    return admission.assessment_lines(*_cands(spark, sf_dir))


@query(f"""WITH {_CANDS}, a AS (SELECT c.*, {_sql_list(admission.FORMS)}[1 + c_custkey % {len(admission.FORMS)}] AS form, coalesce(k, 0) > 0 AS ok FROM c LEFT JOIN r USING (ref)),
    d AS (SELECT *, CASE WHEN form = 'specific_named_concept' OR form = 'stable_topic' AND c_custkey % 3 = 0 THEN 'admit' WHEN form IN ('unclear', 'stable_topic') THEN 'defer' ELSE 'reject' END AS decision FROM a)
    SELECT decision, count(*) AS n, count(*) FILTER (ok) AS resolved, array_to_string(list_slice(list_sort(list(ref)), 1, 3), ',') AS refs FROM d GROUP BY decision""")
def assessment_pilot(spark, sf_dir):
    """Candidates assessed in batches, put together again and decided by a policy: the report's lists."""
    cands, texts = _cands(spark, sf_dir)
    i = F.col("pos")
    dealt = admission.batches(cands, "seed").select(F.col("ref").alias("candidate_ref"), _term(i, admission.FORMS).alias("concept_form"), F.lit("supporting").alias("evidence_role"), _term(i, admission.POTENTIALS).alias("longitudinal_potential"), "pos")
    out = admission.assess(cands.withColumns({"distinct_session_count": F.lit(1), "match_kinds": F.array(F.lit("new")), "session_ids": F.array(F.lit("s"))}), texts, dealt, "named_or_high")
    n = out["judged"].groupBy("decision").agg(F.count("*").alias("n"), F.count_if("evidence_resolved").alias("resolved"))
    few = admission.report_rows(out["judged"]).where("place <= 3").groupBy("decision").agg(F.array_join(F.array_sort(F.collect_list("candidate_ref")), ",").alias("refs"))
    return n.join(few, "decision").select("decision", "n", "resolved", "refs")


@query("""SELECT 'assessments' AS run, 'invalid_concept_form' AS reason, 'C' || min(c_custkey) AS detail FROM customer WHERE c_custkey IN (3, 4) UNION ALL SELECT 'decisions', 'invalid_decision_reason', 'C' || min(c_custkey) FROM customer WHERE c_custkey IN (5, 6)
    UNION ALL SELECT 'missing', 'missing_candidate_ref', 'C' || min(c_custkey) FROM customer WHERE c_custkey <= 6 AND c_custkey NOT IN (2, 3)""")
def annotation_failures(spark, sf_dir):
    """The first failure of assessments and of decisions, in their order, or what is missing."""
    c = _table(spark, sf_dir, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("ref"), F.col("c_custkey").alias("pos"))
    k = F.col("pos")
    ref = F.col("ref").alias("candidate_ref")
    a = c.select(ref, "pos", F.when(k == 3, "x").otherwise("pii").alias("concept_form"), F.lit("central").alias("evidence_role"), F.when(k == 4, "x").otherwise("low").alias("longitudinal_potential"))
    d = c.select(ref, "pos", F.lit("admit").alias("decision"), F.when(k == 5, "pii").when(k == 6, "x").otherwise("stable_topic").alias("reason_code"))
    runs = {"assessments": admission.assessment_failure(c, a), "decisions": admission.admission_failure(c, d), "missing": admission.admission_failure(c, d.where("pos > 6 OR pos IN (2, 3)"))}
    parts = [df.select(F.lit(name).alias("run"), "reason", "detail") for name, df in runs.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""WITH h AS (SELECT o_custkey, o_orderstatus, o_orderpriority, o_orderkey FROM orders), own AS (SELECT DISTINCT o_custkey AS ref, o_orderpriority AS s FROM h WHERE o_orderstatus = 'F'),
    m AS (SELECT o_orderkey AS pos, o_custkey AS cand, o_orderpriority AS s FROM h WHERE o_orderstatus = 'P'),
    j AS (SELECT DISTINCT ref, cand, s FROM own JOIN m USING (s) WHERE cand <> ref AND ref // 10 = cand // 10)
    SELECT ref, count(*) AS n FROM (SELECT DISTINCT ref, cand, s FROM j) GROUP BY ref""")
def provisional_hints(spark, sf_dir):
    """How many other concepts the surface forms of each were taken for; ten concepts in a row share their forms."""
    o = _table(spark, sf_dir, "orders")
    form = F.concat_ws(":", "o_orderpriority", F.floor(F.col("o_custkey") / 10).cast("string"))
    own = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("concept_ref"), form.alias("surface_form"), F.lit("new").alias("resolved_as"))
    maybe = o.where("o_orderstatus = 'P'").groupBy(form.alias("surface_form"), F.col("o_custkey").alias("candidate_concept_ref")).agg(F.min("o_orderkey").alias("pos")).select("pos", "candidate_concept_ref", "surface_form", F.lit("e").alias("evidence_ref"), F.lit("l").alias("existing_canonical_label"))
    hints = admission.provisional_hints(own.select(F.col("concept_ref").alias("ref")).distinct(), own, maybe)
    return hints.where("hints IS NOT NULL").select("ref", F.size("hints").cast("long").alias("n"))


# Context packs from reviews of conversations.
_PACKS = f"""
    c AS (SELECT conv_id, conv_id // 20 AS review_id, conv_id % 7 AS sec, arg_min(text, turn) AS text FROM conversations GROUP BY conv_id),
    p AS (SELECT *, CAST(row_number() OVER (PARTITION BY review_id, sec ORDER BY conv_id) AS INTEGER) AS pos FROM c),
    i AS (SELECT review_id, printf('R:%s:%02d', {_sql_list(context_pack.WORDS.values())}[sec + 1], pos) AS ref, {_sql_list([context_pack.REVIEW_TYPES[k][0] for k in context_pack.WORDS])}[sec + 1] AS type, text FROM p WHERE conv_id % 5 <> 0),
    k AS (SELECT DISTINCT review_id, 'C:PROJECT_NAME' AS ref, 'current_context' AS type, 'P' AS text FROM c UNION ALL SELECT DISTINCT review_id, 'C:CORE_PURPOSE', 'current_context', 'Q' FROM c UNION ALL SELECT DISTINCT review_id, 'R:SUMMARY', 'summary', 'sum' FROM c UNION ALL SELECT * FROM i)"""


def _pack_candidates(spark, sf_dir) -> DataFrame:
    i = F.col("conv_id")
    c = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text")).withColumns({"review_id": F.floor(i / 20), "section": _term(i, list(context_pack.WORDS))})
    c = c.withColumn("pos", F.row_number().over(_window(["review_id", "section"], ["conv_id"])) - 1)
    items = c.select("review_id", "section", "pos", "text", F.when(i % 5 == 0, False).alias("semantic_valid"))
    return context_pack.review_candidates(items.select("review_id").distinct().withColumn("summary", F.lit("sum")), items, context_pack.WORDS, "P", "Q")


@query(f"""WITH {_PACKS} SELECT review_id, string_agg('[' || ref || '] type=' || type || ' support=' || CASE WHEN type IN ('theme', 'tension', 'insight') THEN 'cross_session_interpretation' WHEN type = 'hypothesis' THEN 'hypothesis' WHEN type LIKE '%question' THEN 'open_question' ELSE 'confirmed' END || chr(10) || text, chr(10) || chr(10) ORDER BY ref) AS candidate_text,
    count(*) AS n FROM k GROUP BY review_id""")
def pack_candidates(spark, sf_dir):
    """The candidates of each review's context pack, as an annotator reads them."""
    c = kept(_pack_candidates(spark, sf_dir), "candidates")
    return context_pack.candidate_text(c, ["ref"]).join(c.groupBy("review_id").agg(F.count("*").alias("n")), "review_id")


_SECTION_OF = "CASE " + " ".join(f"WHEN type IN ({', '.join(repr(t) for t in types)}) THEN {i + 1}" for i, (types, _) in enumerate(context_pack.SECTIONS.values())) + " END"
_PACK_LIMIT = "CASE " + " ".join(f"WHEN s = {i + 1} THEN {n}" for i, (_, n) in enumerate(context_pack.SECTIONS.values())) + " END"


@query(f"""WITH {_PACKS}, ch AS (SELECT *, {_SECTION_OF} AS s FROM k WHERE type <> 'current_context'), pl AS (SELECT *, row_number() OVER (PARTITION BY review_id, s ORDER BY ref DESC) AS place FROM ch), ok AS (SELECT * FROM pl WHERE place <= {_PACK_LIMIT}),
    ln AS (SELECT review_id, s, string_agg('* ' || CASE WHEN type = 'hypothesis' THEN '【仮説】' WHEN s = 3 THEN '【AIによる横断的な解釈】' ELSE '' END || text, chr(10) ORDER BY place) AS body FROM ok GROUP BY review_id, s)
    SELECT review_id, '# Context Pack｜P' || repeat(chr(10), 2) || '## このコンテキストの扱い' || repeat(chr(10), 2) || 'U' || repeat(chr(10), 2) || '## 現在の前提' || repeat(chr(10), 2) || '* プロジェクト名：P' || chr(10) || '* 目的：Q'
        || string_agg(repeat(chr(10), 2) || '## ' || {_sql_list(context_pack.TITLES.values())}[s] || repeat(chr(10), 2) || body, '' ORDER BY s) || repeat(chr(10), 2) || '## 今回相談したいこと' || repeat(chr(10), 2) || 'ask' || chr(10) AS markdown FROM ln GROUP BY review_id""")
def context_packs(spark, sf_dir):
    """Context packs as Markdown; the annotator chose all candidates, last refs first, and one that isn't there."""
    c = kept(_pack_candidates(spark, sf_dir), "candidates")
    at = F.row_number().over(_window(["review_id"], ["ref"]))
    chosen = c.select("review_id", "ref", (-at).alias("pos")).unionByName(c.select("review_id").distinct().select("review_id", F.lit("R:NONE:01").alias("ref"), F.lit(-100000).alias("pos")))
    return context_pack.markdown(context_pack.select(chosen, c), c.select("review_id").distinct().withColumn("question", F.lit(" ask ")), "U", "P", "Q")


@query(f"""WITH {_CITED}, {_SUPPORTED}, x AS (SELECT *, CASE WHEN kind = 'decision' THEN 'D' ELSE 'F' END AS ty FROM j WHERE invalid_reason IS NULL AND NOT unsupported_claim AND NOT invalid AND usr AND (kind = 'decision' OR kind = 'fact' AND subject = 'user' AND {_any("claim || CASE WHEN (conv_id + turn) % 4 < 2 THEN '方針' ELSE '' END", context_pack.FACT_HINTS)})),
    y AS (SELECT *, row_number() OVER (PARTITION BY conv_id, ty ORDER BY turn) AS nth FROM x)
    SELECT conv_id // 20 AS review_id, printf('%s:S%02d:%02d', ty, conv_id % 20 + 1, nth) AS ref, CASE ty WHEN 'D' THEN 'decision' ELSE 'user_fact' END AS type FROM y WHERE ty = 'D' OR nth <= 3""")
def pack_facts(spark, sf_dir):
    """Decisions and facts of sessions that can go into a context pack."""
    i = F.col("conv_id")
    s = _supported(spark, sf_dir).withColumns({"review_id": F.floor(i / 20), "session_no": (i % 20 + 1).cast("int"), "pos": F.col("turn"), "text": F.concat("claim", F.when((i + F.col("turn")) % 4 < 2, "方針").otherwise(""))})
    return context_pack.analysis_candidates(s).select("review_id", "ref", "type")


# Lists, lookups and parents with children.


@query("""WITH n AS (SELECT o_custkey, count(*) AS k FROM orders GROUP BY o_custkey), l AS (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last FROM orders GROUP BY o_custkey)
    SELECT c_custkey, coalesce(k, 0) AS order_count, last AS last_order, n_name AS nation, r_name AS region FROM customer LEFT JOIN n ON n.o_custkey = c_custkey LEFT JOIN l ON l.o_custkey = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey""")
def parents_with_children(spark, sf_dir):
    """Every parent with the number of its children, the newest of them, and the titles of its own parents."""
    o = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate")
    c = lists.with_latest(lists.with_counts(_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), o, "c_custkey", "order_count"), o, "c_custkey", "o_orderdate", "o_orderkey")
    n = _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"))
    return c.join(n, "c_nationkey", "left").select("c_custkey", "order_count", F.col("latest.o_orderkey").alias("last_order"), "nation", "region")


@query("""SELECT conv_id // 20 AS review_id, count(*) AS n_sessions, CAST(sum(n) AS BIGINT) AS chars, sum(n) > 80000 AS over_limit, count(*) >= 2 AND sum(n) <= 80000 AS can_run, array_to_string(list_sort(list(conv_id)), ',') AS sessions
    FROM (SELECT conv_id, CAST(coalesce(sum(length(text)) FILTER (role IN ('user', 'assistant')), 0) AS BIGINT) AS n FROM conversations GROUP BY conv_id) GROUP BY 1""")
def review_inputs(spark, sf_dir):
    """The sessions chosen for each review, and whether they are few enough and many enough to be reviewed."""
    m = _table(spark, sf_dir, "conversations")
    s = stats.with_message_stats(m.select("conv_id").distinct(), m, ["conv_id"], content="text").withColumn("review_id", F.floor(F.col("conv_id") / 20))
    return lists.input_checks(s, ["review_id"]).join(lists.gathered(s, "review_id", "conv_id").select("review_id", F.array_join("conv_ids", ",").alias("sessions")), "review_id")


@query("""SELECT 'customers' AS name, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'in_range', count(*) FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') BETWEEN '1996-01-01' AND '1996-12-31'
    UNION ALL SELECT 'open_end', count(*) FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') >= '1997-01-01' UNION ALL SELECT 'filtered', count(*) FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' UNION ALL SELECT 'looked_up', count(*) FROM customer WHERE c_custkey = 7""")
def table_counts(spark, sf_dir):
    """Counts of tables, of rows between days, of filters that may be left open, and of a lookup."""
    o = _table(spark, sf_dir, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    c = _table(spark, sf_dir, "customer")
    some = lists.where_given(o, o_orderstatus="F", o_orderpriority="1-URGENT", o_clerk="")
    named = lambda df, name: df.select(F.lit(name).alias("name"), "n")
    return lists.counts(customers=c, orders=o, filtered=some, looked_up=lists.by_id(c, "c_custkey", 7)).unionByName(named(lists.count_between(o, "day", "1996-01-01", "1996-12-31"), "in_range")).unionByName(named(lists.count_between(o, "day", "1997-01-01", None), "open_end"))


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (3, 1, 7)")
def requested_rows(spark, sf_dir):
    """Rows in the order in which they were asked for; repeats and unknown ids are left out."""
    return joins.in_request_order(_table(spark, sf_dir, "nation"), "n_nationkey", [7, 99, 1, 7, 3]).select("n_nationkey", "n_name")


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'missing_title' WHEN 1 THEN 'invalid_day' WHEN 2 THEN 'invalid_source' WHEN 3 THEN 'missing_text' END AS reason FROM orders""")
def session_inputs(spark, sf_dir):
    """Sessions that can't be created, and why."""
    k = F.col("o_orderkey") % 5
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", F.when(k == 0, " ").otherwise("t").alias("title"), F.when(k == 1, "2024/01/01").otherwise("2024-01-01").alias("occurred_at"), F.when(k == 2, "x").otherwise("a").alias("source"), F.when(k != 3, "text").alias("raw_content"))
    return lists.session_failures(rows, ["a", "b"]).select("o_orderkey", "reason")


@query("""SELECT doc_id, doc_id % 4 = 0 AS ok, CASE WHEN doc_id % 4 = 0 THEN text END AS text, doc_id % 3 = 1 AS attached FROM documents""")
def strict_payloads(spark, sf_dir):
    """Stored payloads: good ones, and ones with a missing field, a wrong type or a broken end; and lists of attachments."""
    from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

    schema = StructType([StructField("text", StringType()), StructField("items", ArrayType(StructType([StructField("n", LongType())])))])
    k = F.col("doc_id") % 4
    good = F.to_json(F.struct("text", F.array(F.struct(F.lit(1).alias("n"))).alias("items")))
    json = F.when(k == 0, good).when(k == 1, F.to_json(F.struct("text", F.array(F.struct(F.lit("x").alias("n"))).alias("items")))).when(k == 2, F.to_json(F.struct(F.col("text").alias("other")))).otherwise(F.concat(F.lit("{"), good))
    attach = F.element_at(F.array(F.lit("[]"), F.lit('[{"id":1}]'), F.lit("[broken")), (F.col("doc_id") % 3).cast("int") + 1)
    v = payloads.parse_strict(F.col("json"), schema, {"text", "items.n"})
    rows = _table(spark, sf_dir, "documents").select("doc_id", json.alias("json"), attach.alias("attach"))
    return rows.select("doc_id", v.alias("v"), "attach").select("doc_id", F.col("v").isNotNull().alias("ok"), F.col("v.text").alias("text"), payloads.has_attachments(F.col("attach")).alias("attached"))


@query(r"""WITH r AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN printf('S%02d:M%03d:E%02d', conv_id + 1, turn + 1, 1) WHEN 1 THEN printf(' m%03d:e%02d ', turn + 1, 2) ELSE 'M1-E2' END AS ref, printf('S%02d:M001:E01', conv_id % 3) AS other FROM conversations)
    SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN conv_id + 1 - 1 END AS session, CASE WHEN turn % 3 < 2 THEN turn END AS message, CASE turn % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 END AS unit, concat_ws(',', other, CASE WHEN trim(ref) <> other THEN trim(ref) END) AS refs,
        concat_ws(',', printf('S%02d', conv_id % 3), CASE WHEN turn % 3 = 0 AND conv_id + 1 <> conv_id % 3 THEN printf('S%02d', conv_id + 1) END) AS sessions FROM r""")
def parsed_refs(spark, sf_dir):
    """Refs taken apart, united in order without repeats, and their sessions."""
    k = F.col("turn") % 3
    ref = F.when(k == 0, F.format_string("S%02d:M%03d:E%02d", F.col("conv_id") + 1, F.col("turn") + 1, F.lit(1))).when(k == 1, F.format_string(" m%03d:e%02d ", F.col("turn") + 1, F.lit(2))).otherwise("M1-E2")
    other = F.format_string("S%02d:M001:E01", F.col("conv_id") % 3)
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", units.parse_ref(ref).alias("p"), review.ordered_refs(F.array(other, F.lit(" ")), F.array(ref, other)).alias("refs"))
    return rows.select("conv_id", "turn", F.col("p.session").cast("long").alias("session"), F.col("p.message").cast("long").alias("message"), F.col("p.unit").alias("unit"), F.array_join("refs", ",").alias("refs"), F.array_join(review.ref_sessions(F.col("refs")), ",").alias("sessions"))


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN '変化' WHEN 'view' THEN '接続' ELSE '緊張関係' END AS kind, CASE WHEN event_id % 4 = 3 THEN NULL WHEN event_id % 4 = 0 THEN CASE WHEN event_id % 2 = 0 AND event_id % 3 = 0 THEN '過去Sessionで確認された問い' ELSE '元発言から確認' END WHEN event_id % 4 = 1 THEN 'まだ確認されていない仮説' ELSE 'AIによる横断的な解釈' END AS support,
    CASE WHEN event_id % 2 = 0 THEN '2024-01-01T00:00:00Z' ELSE strftime(ts, '%Y-%m-%d') END AS thought_at FROM events""")
def shown_labels(spark, sf_dir):
    """Labels of kinds and of what supports an item, and when a concept was thought of."""
    i = F.col("event_id")
    kind = F.when(F.col("event_type") == "click", "shift").when(F.col("event_type") == "view", "connection").otherwise("tension")
    support = F.when(i % 4 == 3, None).when(i % 4 == 0, "direct").when(i % 4 == 1, "hypothesis").otherwise("cross_session_interpretation")
    item = F.when((i % 4 == 0) & (i % 3 == 0), "openQuestion").otherwise("theme")
    at = concepts.concept_time(F.when(i % 2 == 0, " 2024-01-01T00:00:00Z ").otherwise(" "), F.date_format("ts", "yyyy-MM-dd"))
    return _table(spark, sf_dir, "events").select("event_id", L.kind_label(kind).alias("kind"), L.support_label(item, support).alias("support"), at.alias("thought_at"))
