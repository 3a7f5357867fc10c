"""Cases with rows worked out by hand."""

import json
import time

import pytest
from pyspark.sql import functions as F

from threadloom.functions import dates as D
from threadloom.functions import labels as L
from threadloom.functions import text as T
from threadloom.operators import evidence as E
from threadloom.operators import containment, findings, guards, joins, ranking, sessions, stats, units
from threadloom.plans import admission, concepts, context_pack, observations, queries, review
from threadloom.sources import export, payloads, sinks, transcript


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_gap_of_exactly_five_hours_splits(spark):
    rows = [("c", i, t) for i, t in enumerate([0.0, 5 * 3600.0, None, 6 * 3600.0, 6 * 3600.0 + 17999])]
    df = spark.createDataFrame(rows, "conv string, pos int, at double")
    got = [r.session for r in sessions.gap_sessions(df, ["conv"], ["pos"], "at").orderBy("pos").collect()]
    assert got == [0, 1, 1, 1, 1]
    assert {r.session for r in sessions.gap_sessions(df, ["conv"], ["pos"], "at", 8 * 3600).collect()} == {0}
    assert {r.session for r in sessions.gap_sessions(df, ["conv"], ["pos"], "at", None).collect()} == {0}


def test_transcript_offsets_slice_back(spark):
    m = spark.createDataFrame([("s", 0, "user", "héllo"), ("s", 1, "assistant", "😀 hi"), ("s", 2, "user", "x")], "s string, i int, role string, content string")
    whole = sessions.transcripts(m, ["s"], ["i"])
    assert whole.first().raw_content == "User:\nhéllo\n\nAssistant:\n😀 hi\n\nUser:\nx"
    placed = sessions.transcript_offsets(m, ["s"], ["i"]).join(whole, "s")
    assert sessions.broken_anchors(placed, "raw_content", "char_start", "char_end", "content").count() == 0
    assert sessions.broken_anchors(placed.withColumn("char_start", F.col("char_start") + 1), "raw_content", "char_start", "char_end", "content").count() == 3


@pytest.mark.parametrize("text,want", [
    ("", []), ("   ", []), ("short", ["short"]), ("A first sentence is here. Second one follows now!  Third", ["A first sentence is here.", "Second one follows now!", "Third"]),
    ("Pi is 3.14159 and that is a long number. Ok", ["Pi is 3.14159 and that is a long number.", "Ok"]), ("a" * 400, ["a" * 400]), ("一。" * 15, ["一。" * 10, "一。" * 5]),
    ("line one\nline two which goes on\nend", ["line one\nline two which goes on", "end"]),
])
def test_unit_split(text, want):
    got = units.split_text(text)
    assert [u["text"] for u in got] == want
    assert all(text[u["start"] : u["end"]] == u["text"] for u in got)


def test_unit_refs(spark):
    rows = [("c", 0, "system", "no"), ("c", 1, " User", "one"), ("c", 2, "assistant", "two"), ("c", 3, "user", "This is the first long part. And this the second.")]
    df = spark.createDataFrame(rows, "c string, turn int, role string, content string")
    got = units.evidence_units(df, ["c"], ["turn"], roles=("user",)).orderBy("message_no", "unit_no").collect()
    assert [r.ref for r in got] == ["M001:E01", "M003:E01", "M003:E02"]
    r = one(spark, units.parse_ref(F.lit("s01:m003:e02")).alias("a"), units.parse_ref(F.lit("M1000:E01")).alias("b"), units.parse_ref(F.lit("x")).alias("c"))
    assert tuple(r.a) == (0, 2, 1) and tuple(r.b) == (None, 999, 0) and r.c is None


@pytest.mark.parametrize("raw,want", [
    ("", []), ("User: hi\nAssistant: hello\nmore", [("user", "hi\n"), ("assistant", "hello\nmore")]), ("intro\n  you SAID:\n\nx", [("unknown", "intro\n"), ("user", "\nx")]),
    ("a\n\n\nb", [("unknown", "a"), ("unknown", "b")]), ("ユーザー：はい\nUser:\nUser: z", [("user", "はい\n"), ("user", "z")]), ("  \n", [("unknown", "  \n")]), ("User:", [("unknown", "User:")]),
])
def test_transcript_parser(raw, want):
    got = transcript.parse(raw)
    assert [(m["role"], m["content"]) for m in got] == want
    assert all(raw[m["char_start"] : m["char_end"]] == m["content"] for m in got) and [m["index"] for m in got] == list(range(len(got)))


def test_export(spark, tmp_path):
    msg = lambda role, parts, kind="text", **k: {"id": "m", "author": {"role": role}, "create_time": 5.5, "content": {"content_type": kind, "parts": parts}, **k}
    nodes = {
        "r": {"id": "r", "parent": None}, "a": {"id": "a", "parent": "r", "message": msg("user", ["hi", {"text": "you"}, {"content_type": "image_asset_pointer", "asset_pointer": "f://1"}], "multimodal_text", metadata={"attachments": [{"id": "z", "name": "n", "mime_type": "t", "size": 3}]})},
        "b": {"id": "b", "parent": "a", "message": msg("assistant", ["dead end"])}, "c": {"id": "c", "parent": "a", "message": msg("tool", ["x"])}, "d": {"id": "d", "parent": "c", "message": msg("assistant", ["yes"])}, "e": {"id": "e", "parent": "d", "message": msg("assistant", [" "])},
    }
    conv = {"conversation_id": "k1", "id": "other", "title": " T ", "create_time": 1.0, "update_time": "no", "current_node": "e", "mapping": nodes}
    (tmp_path / "a.json").write_text(json.dumps([conv, {"id": "bad"}]))
    (tmp_path / "b.json").write_text(json.dumps({"conversations": [dict(conv, title="later"), {"id": "k2", "title": "", "mapping": {"x": {"parent": "y"}, "y": {"parent": "x"}}, "current_node": "x"}]}))
    (tmp_path / "c.txt").write_text("x")
    convs = export.conversations(export.read_exports(spark, str(tmp_path)))
    got = {r.external_id: r for r in convs.drop("nodes").collect()}
    assert got["k1"].title == "T" and got["k1"].created == 1.0 and got["k1"].updated is None and got["k2"].title == export.NO_TITLE and set(got) == {"k1", "k2"}
    branch = export.live_branch(convs)
    assert [r.node_id for r in branch.where("external_id = 'k1'").orderBy("pos").collect()] == ["r", "a", "c", "d", "e"]
    assert [r.node_id for r in branch.where("external_id = 'k2'").orderBy("pos").collect()] == ["y", "x"]
    m = export.visible_messages(branch).orderBy("pos").collect()
    assert [(r.role, r.content) for r in m if not r.skipped] == [("user", "hi\nyou"), ("assistant", "yes")] and sum(r.skipped for r in m) == 2
    assert [a.asset_pointer for a in m[0].attachments] == [None, "f://1"]


def test_text_rules(spark):
    x = F.lit
    r = one(
        spark, T.concept_key(x(" Ｇｏｏｄ　 Idea ")).alias("key"), T.concept_label(x("a \u3000 b")).alias("label"), T.is_weak_question(x("今後どう進めるか")).alias("weak"), T.is_generic_theme(x("AI 活用。")).alias("theme"),
        T.leaps_domain(x("顧客獲得が進む"), x("顧客獲得")).alias("l1"), T.leaps_domain(x("顧客獲得が進む"), x("")).alias("l2"), T.near_duplicates(x("あ、い。"), x("xあいy")).alias("near"), T.near_duplicates(x(""), x("a")).alias("far"),
        T.fnv1a(x("C01")).alias("fnv"), T.is_honorific(x("田中さん")).alias("h1"), T.is_honorific(x("皆さん")).alias("h2"), T.has_honorific(x("明日田中さんと会う")).alias("h3"), T.is_compound(x("A vs B")).alias("c1"), T.is_compound(x("仕事と生活")).alias("c2"),
        T.candidate_reason(x("今日")).alias("deny"), T.alias_reason(x("とても長いエイリアスの名前です"), x("短い")).alias("alias"), T.is_divergent(x("りんご"), x("みかん")).alias("d1"), T.is_divergent(x("りんご"), x("りんご酒")).alias("d2"),
        T.is_over_general(x("赤いりんご"), x("りんご")).alias("o1"), T.is_over_general(x("りんごを"), x("りんご")).alias("o2"), T.asserts_inner_state(x("ユーザーは昨日それに気づいた")).alias("inner"), T.quote_found(x("a b c"), x(" b ")).alias("q1"), T.quote_found(x("abc"), x("  ")).alias("q2"),
    )
    assert (r.key, r.label, r.weak, r.theme, r.l1, r.l2, r.near, r.far, r.fnv) == ("goodidea", "a b", True, True, False, True, True, False, 2691943669)
    assert (r.h1, r.h2, r.h3, r.c1, r.c2, r.deny, r.alias, r.d1, r.d2, r.o1, r.o2, r.inner, r.q1, r.q2) == (True, False, True, True, True, "generic_term", "too_divergent", True, False, True, False, True, True, False)


def test_dates(spark):
    day = F.lit("2026-08-19").cast("date")
    now = F.lit("2026-08-18 00:00:00").cast("timestamp")
    r = one(
        spark, D.week_range(day).alias("week"), D.week_range(day, 1).alias("last"), D.last_days(day, 7).alias("days"), D.slashed(F.lit("2026-08-05T10:00:00Z")).alias("s"), D.slashed(F.lit("x")).alias("n"), D.days_between(F.lit("2026-08-08"), now).alias("b"),
        D.within(F.lit("2026-01-05"), "", "2026-01-05").alias("w"), D.percent(F.lit(0.125)).alias("p"), D.spotlight_score(F.lit("shift"), F.lit("2026-08-04"), F.lit("2026-08-04"), F.lit(5), F.lit(None).cast("string"), now).alias("score"),
    )
    assert (tuple(r.week), tuple(r["last"]), tuple(r.days)) == (("2026-08-17", "2026-08-23"), ("2026-08-10", "2026-08-16"), ("2026-08-13", "2026-08-19"))
    assert (r.s, r.n, r.b, r.w, r.p, r.score) == ("2026/08/05", None, 10.0, True, 13, 5.0 + 2 + 3 + 1.5 + 1.5 + 0.5)


@pytest.mark.parametrize("n,want", [(1, [1]), (7, [7]), (8, [8]), (12, [6, 6])])
def test_batches(spark, n, want):
    df = spark.createDataFrame([("k", f"C{i:02d}") for i in range(n)], "k string, ref string")
    assert sorted(r["count"] for r in ranking.balanced_batches(df, ["k"], "ref", "s").groupBy("batch_no").count().collect()) == want


def _ev(ok=True, session="s1", role="user", quote="q", day="2026-01-01", reason=None):
    return {"message_ref": "M001:E01", "quote": quote, "validated": ok, "reason": reason, "role": role, "message_id": "m", "session_id": session, "occurred_at": day}


def _verdict(spark, make, **evs):
    df = spark.createDataFrame([tuple(evs.values())], ", ".join(f"{k} array<{E.EVIDENCE}>" for k in evs))
    v = df.select(make(*(F.col(k) for k in evs)).alias("v")).first().v
    return v.valid, v.reason, v.guard_type


def test_guards(spark):
    two, one_ = [_ev(), _ev(session="s2")], [_ev()]
    bad = [_ev(ok=False, reason="quote_not_found")]
    assert _verdict(spark, lambda e: guards.theme(F.lit("ok"), e), e=two) == (True, None, "interpretation")
    assert _verdict(spark, lambda e: guards.theme(F.lit("ok"), e), e=one_) == (False, "insufficient_distinct_sessions", "hard")
    assert _verdict(spark, lambda e: guards.theme(F.lit("ok"), e), e=two + bad) == (False, "invalid_evidence_ref", "hard")
    assert _verdict(spark, lambda e: guards.tension(F.lit("顧客獲得"), e), e=one_) == (False, "domain_leap", "hard")
    assert _verdict(spark, lambda e: guards.tension(F.lit("恐れている"), e), e=one_) == (False, "insufficient_distinct_sessions", "interpretation")
    assert _verdict(spark, lambda e: guards.tension(F.lit("恐れている"), e), e=two) == (False, "unrelated_interpretation", "interpretation")
    assert _verdict(spark, lambda e, a, b: guards.tension(F.lit("x"), e, a, b), e=two, a=one_, b=one_) == (False, "insufficient_distinct_sessions", "interpretation")
    assert _verdict(spark, lambda e: guards.hypothesis(F.lit("劇的"), e), e=two) == (False, "unsupported_exaggeration", "interpretation")
    assert _verdict(spark, lambda e: guards.theme(F.lit("ユーザーは気づいた"), e), e=[_ev(role="assistant"), _ev(role="assistant", session="s2")]) == (False, "evidence_role_mismatch", "hard")
    late = [_ev(session="s2", day="2026-02-01")]
    assert _verdict(spark, guards.shift, a=one_, b=late) == (True, None, "hard")
    assert _verdict(spark, guards.shift, a=late, b=one_) == (False, "invalid_chronology", "hard")
    assert _verdict(spark, guards.shift, a=one_, b=one_) == (False, "unsupported_cross_session_claim", "hard")
    assert _verdict(spark, guards.shift, a=one_, b=[]) == (False, "insufficient_distinct_sessions", "hard")
    assert _verdict(spark, guards.shift, a=one_, b=[_ev(session="s2", role="assistant", day="2026-02-01")]) == (False, "evidence_role_mismatch", "hard")
    order = F.array(F.lit("s2"), F.lit("s1"))
    assert _verdict(spark, lambda a, b: guards.shift(a, b, order), a=one_, b=[_ev(session="s2")])[1] == "invalid_chronology"
    assert _verdict(spark, lambda e: guards.next_question(F.lit(" "), e), e=[]) == (False, "weak_next_question", "interpretation")
    assert _verdict(spark, lambda e: guards.duplicate_insight(guards.tension(F.lit("あい"), e), F.lit("あい"), F.array(F.lit("あ い。"))), e=two)[1] == "duplicate_interpretation"


def test_support(spark):
    ask = lambda k, s, e: _verdict(spark, lambda x: F.struct(F.lit(True).alias("valid"), E.support_reason(F.lit(k), F.lit(s), x).alias("reason"), F.lit("").alias("guard_type")), e=e)[1]
    assert ask("hypothesis", "user", []) == "unsupported_subject_kind" and ask("decision", "user", []) == "missing_user_evidence"
    assert ask("decision", "user", [_ev(role="assistant")]) == "evidence_role_mismatch" and ask("decision", "user", [_ev()]) is None and ask("open_question", "external", []) is None


def test_refs_are_resolved(spark):
    m = spark.createDataFrame([("c", "m1", "hello world, this is it")], "c string, message_id string, content string")
    u = spark.createDataFrame([("c", "M001:E01", "hello world", 0, 11, "user", "m1"), ("c", "M001:E02", "moved", 0, 5, "user", "m1"), ("c", "M002:E01", "x", 0, 1, "user", "gone")], "c string, ref string, unit_text string, unit_start int, unit_end int, role string, message_id string")
    items = spark.createDataFrame([("c", 1, [" M001:E01", "M009:E01", "M001:E02", "M001:E01"]), ("c", 2, ["M002:E01"]), ("c", 3, [])], "c string, item_id int, refs array<string>")
    got = {r.item_id: [(e.validated, e.reason) for e in r.evidence] for r in E.resolve_refs(items, u, m, ["c"]).collect()}
    assert got == {1: [(True, None), (False, "invalid_evidence_ref"), (False, "quote_not_found")], 2: [(False, "invalid_message_ref")], 3: []}
    s = stats.evidence_stats(E.resolve_refs(items, u, m, ["c"]), ["c"]).first()
    assert (s.evidence_count, s.validated_count, s.validation_rate) == (4, 1, 0.25)


ACTIONS = "reg string, session_id string, batch_no int, pos int, evidence_ref string, action string, surface_form string, existing_ref string, ground_reason string"


def _resolved(spark, rows, seeds=None):
    df = spark.createDataFrame([("r", "s", b, p, u, a, x, e, g) for p, b, u, a, x, e, g in rows], ACTIONS)
    reg = spark.createDataFrame([("r", *x) for x in seeds], "reg string, concept_ref string, concept_id string, canonical_label string, aliases array<string>") if seeds else None
    out = concepts.resolve(df, ["reg"], reg)
    return df, out, sorted((r.pos, r.status, r.concept_ref, r.resolved_as, r.match_kind, r.reason, r.detail, r.candidate_ref) for r in out.collect())


def test_concept_identities(spark):
    new = lambda p, b, u, x: (p, b, u, "new", x, None, None)
    rows = [new(1, 0, "u1", "Apple"), new(2, 0, "u1", "apple "), new(3, 0, "u1", "今日"), new(4, 0, "u1", "b"), new(5, 0, "u1", "c"), new(6, 0, "u1", "d"), new(7, 1, "u2", "ＡＰＰＬＥ"), new(8, 1, "u2", "田中さん")]
    got = {p: (ref, as_, kind, why, more) for p, _, ref, as_, kind, why, more, _ in _resolved(spark, rows)[2]}
    assert got == {
        1: ("C01", "new", None, None, None), 2: (None, None, None, "duplicate_concept_in_unit", None), 3: (None, None, None, "invalid_candidate", "generic_term"), 4: ("C02", "new", None, None, None), 5: ("C03", "new", None, None, None),
        6: (None, None, None, "max_concepts_per_unit", None), 7: ("C01", "match", "exact", None, None), 8: (None, None, None, "honorific_person", None),
    }


def test_actions_resolve_against_a_registry(spark):
    seeds = [("C01", "k1", "Apple", ["fruit", "Pome"]), ("C02", "k2", "Pear", ["fruit"]), ("C03", "k3", "今日", [])]
    rows = [
        (1, 0, "u1", "match", "apple", "C99", None), (2, 0, "u1", "new", "pome", None, None), (3, 0, "u2", "new", "pome", None, None), (4, 0, "u2", "match", "fruit", "C02", None), (5, 0, "u3", "match", "quince", "C05", None), (6, 0, "u3", "match", "quince", "C04", None),
        (7, 0, "u4", "match", "今日", "C01", None), (8, 0, "u4", "new", "今日", None, None), (9, 1, "u5", "match", "fruit", "C77", None), (10, 1, "u6", "skip", "", None, None), (11, 1, "u7", "uncertain", "", None, None), (12, 1, "u8", "new", "zebra", None, "surface_not_in_unit"), (13, 1, "u9", "match", "quince", "C77", None), (14, 1, "u9", "match", "相談", "C04", None),
    ]
    df, out, got = _resolved(spark, rows, seeds)
    assert got == [
        (1, "accepted", "C01", "match", "exact", None, None, None), (2, "rejected", None, None, None, "duplicate_concept_in_unit", None, None), (3, "accepted", "C01", "match", "observed_alias", None, None, None),
        (4, "accepted", "C04", "new", "semantic", None, None, None), (4, "provisional_match", None, None, "semantic", None, None, "C02"), (5, "rejected", None, None, None, "unknown_concept_ref", "C05", None),
        (6, "accepted", "C05", "new", "semantic", None, None, None), (6, "provisional_match", None, None, "semantic", None, None, "C04"), (7, "accepted", "C03", "match", "exact", None, None, None), (8, "rejected", None, None, None, "invalid_candidate", "generic_term", None),
        (9, "accepted", "C04", "match", "exact", None, None, None), (10, "skip", None, None, None, None, None, None), (11, "uncertain", None, None, None, None, None, None), (12, "rejected", None, None, None, "surface_not_in_unit", None, None),
        (13, "accepted", "C05", "match", "exact", None, None, None), (14, "provisional_match", None, None, "semantic", None, None, "C04"), (14, "rejected", None, None, None, "invalid_candidate", "generic_term", None),
    ]
    m = concepts.metrics(out, ["reg"]).first()
    assert (m.match, m.new, m.skip, m.uncertain, m.rejected, m.occurrences, m.unique_concepts, m.provisional_match) == (5, 2, 1, 1, 5, 7, 4, 3)
    text = concepts.catalog_text(concepts.catalog(out, ["reg"], spark.createDataFrame([("r", *x) for x in seeds], "reg string, concept_ref string, concept_id string, canonical_label string, aliases array<string>")), ["reg"]).first().catalog_text
    assert text == "C01 | Apple | aliases: fruit, Pome\nC02 | Pear | aliases: fruit\nC03 | 今日\nC04 | fruit\nC05 | quince"


def _fold(rows):
    """The same one action at a time, from an empty registry; (pos, status, ref)."""
    keys, first, units, out = {}, {}, {}, []
    for p, b, u, a, x, e, _ in rows:
        k = x.lower()
        if a == "match" and k not in keys:
            if e not in keys.values():
                out.append((p, "rejected", None))
                continue
            out.append((p, "provisional_match", None))
        mine = units.setdefault(u, set())
        if k in mine or len(mine) == 3:
            out.append((p, "rejected", None))
            continue
        mine.add(k)
        keys.setdefault(k, f"C{len(keys) + 1:02d}")
        out.append((p, "accepted", keys[k]))
    return sorted(out, key=str)


def test_resolution_is_that_of_one_action_at_a_time(spark):
    import random

    rng = random.Random(8)
    for _ in range(3):
        rows = [(p, p // 9, f"u{p // 4}", rng.choice(["new", "match", "match"]), f"w{rng.randrange(12)}", f"C{rng.randrange(1, 12):02d}", None) for p in range(60)]
        got = sorted(((p, status, ref) for p, status, ref, *_ in _resolved(spark, rows)[2]), key=str)
        assert got == _fold(rows)


def test_aliases_are_unique(spark):
    df = spark.createDataFrame([("k", "Apple", a, i) for i, a in enumerate([" apple", "Fruit ", "ＦＲＵＩＴ", "", "Pome"])], "id string, label string, alias string, i int")
    assert sorted(tuple(r) for r in concepts.unique_aliases(df, "id", "label", "alias", "i").collect()) == [("k", 1, "Fruit"), ("k", 2, "Pome")]
    r = one(spark, concepts.concept_time(F.lit(" "), F.lit("d")).alias("a"), concepts.concept_time(F.lit(" t "), F.lit("d")).alias("b"))
    assert tuple(r) == ("d", "t")


def test_coverage(spark):
    want = spark.createDataFrame([("b1", "M1"), ("b1", "M2"), ("b2", "M1"), ("b3", "M1")], "b string, evidence_ref string")
    c = "array<struct<action:string,surface_form:string,existing_ref:string>>"
    some = [{"action": "new", "surface_form": "x", "existing_ref": None}]
    got = spark.createDataFrame([("b1", "M1", 0, "skip", []), ("b2", "M1", 0, "extracted", []), ("b2", "M7", 1, "skip", []), ("b3", "M1", 0, "extracted", some)], f"b string, evidence_ref string, pos int, disposition string, concepts {c}")
    assert {tuple(r) for r in concepts.coverage(want, got, ["b"]).collect()} == {("b1", "missing_unit", "M2"), ("b2", "extracted_concept_count", "M1")}
    assert [r.action for r in concepts.flatten_actions(got).orderBy("b", "pos").collect()] == ["skip", "skip", "new"]


def test_candidates_and_policy(spark):
    cs = spark.createDataFrame([("C01", "Apple", "apple"), ("C02", "B", "b")], "ref string, canonical_label string, normalized_key string")
    acts = spark.createDataFrame([(0, "C01", "s2", "M1", "ap", "new", None), (1, "C01", "s2", "M1", "again", "match", "exact"), (2, "C01", "s1", "M2", "x" * 99, "match", "exact"), (3, "C01", "s1", "M3", "y", "rejected", None)], "pos int, concept_ref string, session_id string, evidence_ref string, surface_form string, resolved_as string, match_kind string")
    f = spark.createDataFrame([("C01", "long_label"), ("C01", "long_label")], "concept_ref string, kind string")
    d = spark.createDataFrame([("s1", "2026-01-02"), ("s2", "2026-01-01")], "session_id string, occurred_at string")
    u = spark.createDataFrame([("s2", "M1", " unit  text ")], "session_id string, evidence_ref string, text string")
    got = {r.ref: r for r in admission.candidates(cs, acts, f, d, u).collect()}
    a = got["C01"]
    assert (a.occurrence_count, a.distinct_session_count, a.first_seen_at, a.last_seen_at, a.session_ids, a.evidence_refs, a.match_kinds, a.suspicious_flags) == (2, 2, "2026-01-01", "2026-01-02", ["s1", "s2"], ["M1", "M2"], ["exact", "new"], ["long_label"])
    assert [x.short_text for x in a.representative_evidence] == ["unit text", "x" * 80] and got["C02"].occurrence_count == 0
    rows = admission.candidates(cs, acts, f, d, u).withColumns({"concept_form": F.lit("stable_topic"), "evidence_role": F.lit("incidental"), "longitudinal_potential": F.lit("low")})
    assert {r.ref: r.decision for r in admission.decide(rows, "topic_plus_signal").collect()} == {"C01": "admit", "C02": "defer"}
    bad = spark.createDataFrame([(0, "C01", "stable_topic", "central", "high"), (1, "C09", "x", "x", "x")], "pos int, candidate_ref string, concept_form string, evidence_role string, longitudinal_potential string")
    assert tuple(admission.assessment_failure(cs, bad).first()) == ("unknown_candidate_ref", "C09")
    assert tuple(admission.assessment_failure(cs, bad.where("pos = 0")).first()) == ("missing_candidate_ref", "C02")


def test_findings(spark):
    c = spark.createDataFrame([("C01", "k1", "りんご", "りんご", ["みかん"]), ("C02", "k2", "赤いりんご", "赤いりんご", ["田中さん"]), ("C03", "k3", "みかん", "みかん", [])], "ref string, concept_id string, canonical_label string, normalized_key string, aliases array<string>")
    o = spark.createDataFrame([("k1", "s", "M1"), ("k1", "s", "M2"), ("k2", "s", "M1")], "concept_id string, session_id string, evidence_ref string")
    got = {(r.kind, r.concept_ref, r.other_ref) for r in findings.of_concepts(c, o).collect()}
    assert got == {("singleton_new", "C02", None), ("singleton_new", "C03", None), ("alias_honorific_person", "C02", None), ("normalized_key_containment", "C01", "C02"), ("alias_canonical_collision", "C01", "C03")}
    assert findings.of_sessions(o, spark.createDataFrame([("s", 3)], "session_id string, user_unit_count int")).count() == 0


def _reviews(spark):
    ev = "array<struct<session_id:string,occurred_at:string>>"
    item = f"struct<text:string,interpretation:string,semantic_valid:boolean,support_type:string,distinct_session_count:int,evidence:{ev},before_evidence:{ev},after_evidence:{ev},side_a_evidence:{ev},side_b_evidence:{ev}>"
    mk = lambda text, ok=None, e=(), b=(): (text, None, ok, "direct", None, list(e), list(b), None, None, None)
    rows = [("r1", "integrated-review-v5", "2026-03-01", [mk("hidden", False), mk(" moved ", None, [("s1", None)], [("s2", "2026-01-01")])], [mk("link", True, [("s1", "2026-02-02")])], []), ("r2", "old", "2026-03-01", [mk("no")], [], [])]
    return spark.createDataFrame(rows, f"review_id string, prompt_version string, detected_at string, shifts array<{item}>, cross_insights array<{item}>, tensions array<{item}>")


def test_observations(spark, tmp_path):
    s = spark.createDataFrame([("s1", "2026-02-01", "One"), ("s2", "2026-01-01", "Two")], "session_id string, occurred_at string, title string")
    got = observations.project(_reviews(spark), s)
    rows = {r.source_ref: (r.kind, r.title, r.first_seen_at, r.last_seen_at, r.session_ids, r.distinct_session_count) for r in got.collect()}
    assert rows == {"R:SHIFT:02": ("shift", "moved", "2026-01-01", "2026-02-01", ["s2", "s1"], 2), "R:INSIGHT:01": ("connection", "link", "2026-02-02", "2026-02-02", ["s1"], 1)}
    path = str(tmp_path / "obs")
    assert sinks.insert_if_absent(got, path, observations.IDENTITY) == 2
    assert sinks.insert_if_absent(got, path, observations.IDENTITY) == 0
    n = observations.backfill_counts(_reviews(spark), got, spark.read.parquet(path)).first()
    assert tuple(n) == (2, 1, 1, 0, 2)
    home = observations.home(got, s, spark.createDataFrame([("r1", "Review")], "review_id string, title string")).collect()
    assert {(r.kind, r.review_title, len(r.sessions)) for r in home} == {("shift", "Review", 2), ("connection", "Review", 1)}


def test_context_pack(spark):
    cand = [("r", "C:PROJECT_NAME", "current_context", "P"), ("r", "C:CORE_PURPOSE", "current_context", "Q"), ("r", "R:SUMMARY", "summary", "sum"), ("r", "R:HYPOTHESIS:01", "hypothesis", "hyp"), ("r", "R:TENSION:01", "tension", "t1"), ("r", "R:TENSION:02", "tension", "t2"), ("r", "R:TENSION:03", "tension", "t3")]
    c = spark.createDataFrame(cand, "review_id string, ref string, type string, text string")
    chosen = spark.createDataFrame([("r", i, x) for i, x in enumerate(["R:TENSION:03", "nope", "R:TENSION:03", "R:TENSION:01", "R:TENSION:02", " R:SUMMARY", "R:HYPOTHESIS:01"])], "review_id string, pos int, ref string")
    got = context_pack.select(chosen, c)
    assert sorted((r.section, r.place, r.ref) for r in got.collect()) == [("current_state", -1, "C:PROJECT_NAME"), ("current_state", 0, "C:CORE_PURPOSE"), ("current_state", 1, "R:SUMMARY"), ("hypotheses", 1, "R:HYPOTHESIS:01"), ("tensions", 1, "R:TENSION:03"), ("tensions", 2, "R:TENSION:01")]
    text = context_pack.markdown(got, spark.createDataFrame([("r", " ask ")], "review_id string, question string"), "U", "P", "Q").first().markdown
    assert text.startswith("# Context Pack｜P\n\n## このコンテキストの扱い\n\nU\n\n## 現在の前提\n\n") and "## 緊張関係・注意点\n\n* t3\n* t1\n\n## 仮説\n\n* 【仮説】hyp\n\n## 今回相談したいこと\n\nask\n" in text


def test_strict_payloads(spark):
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("summary string, kind string, items array<struct<text: string, n: int>>")
    good, part, wrong, kind, more = '{"summary":"s","items":[{"text":"a"}]}', '{"summary":"s","items":[{"n":1}]}', "{", '{"summary":"s","kind":"z"}', '{"summary":"s","x":1}'
    df = spark.createDataFrame([(x,) for x in (good, part, wrong, kind, more)], "p string")
    ok = [r.v is not None for r in df.select(payloads.parse_strict(F.col("p"), schema, {"summary", "items.text"}, {"kind": ["a"]}, ["summary", "kind", "items"]).alias("v")).collect()]
    assert ok == [True, False, False, False, False]
    r = one(spark, payloads.has_attachments(F.lit("[1]")).alias("a"), payloads.has_attachments(F.lit("{}")).alias("b"), payloads.has_attachments(F.lit("[")).alias("c"))
    assert tuple(r) == (True, False, False)


def test_joins(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, x string")
    assert [r.id for r in joins.in_request_order(df, "id", [3, 9, 1, 3]).collect()] == [3, 1]
    k = spark.createDataFrame([(1, "ab"), (2, "xabx"), (3, "a"), (4, "ab"), (5, "zzz")], "id int, k string")
    assert {(r.inner_id, r.outer_id) for r in joins.key_containment(k, "id", "k").collect()} == {(1, 2), (1, 4), (4, 1), (4, 2)}


def test_stream_appends_once(spark, tmp_path):
    from threadloom.streaming import stream_insert_if_absent

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "id int, x string").coalesce(1).write.parquet(src)
    for n in range(2):
        stream_insert_if_absent(spark.readStream.schema("id int, x string").parquet(src), out, ["id"], str(tmp_path / f"ck{n}")).awaitTermination()
        assert spark.read.parquet(out).count() == 2


def _row_ev(session, day="2024-01-01", role="user", quote="q", validated=True, reason=None):
    return ("m", quote, validated, reason, role, "1", session, day)


def test_review_sections_are_judged_and_limited(spark):
    two, one_ = [_row_ev("a"), _row_ev("b", "2024-01-05")], [_row_ev("a")]
    bad = [_row_ev("a", validated=False, reason="quote_not_found")]
    rows = [
        (1, "themes", 0, "A plain theme", two, None, None, None, None), (1, "themes", 1, "Too few", one_, None, None, None, None), (1, "themes", 3, "over the limit", two, None, None, None, None),
        (1, "insights", 0, "a plain theme and more", two, None, None, None, None), (1, "insights", 1, "A plain theme", two, None, None, None, None), (1, "shifts", 0, "later", two, None, None, one_, [_row_ev("b", "2024-01-05")]),
        (1, "shifts", 1, "earlier", two, None, None, [_row_ev("b", "2024-01-05")], one_), (1, "open_questions", 0, "why", bad, None, None, None, None), (2, "insights", 0, "A plain theme", two, None, None, None, None),
    ]
    ddl = f"review_id int, section string, pos int, text string, evidence array<{E.EVIDENCE}>, " + ", ".join(f"{c} array<{E.EVIDENCE}>" for c in ("side_a", "side_b", "before", "after"))
    sess = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "review_id int, session_id string, session_no int")
    judged = review.judge(spark.createDataFrame(rows, ddl), sess)
    got = {(r.review_id, r.section, r.pos): r for r in judged.collect()}
    assert {k: r.invalid_reason for k, r in got.items()} == {
        (1, "themes", 0): None, (1, "themes", 1): "insufficient_distinct_sessions", (1, "insights", 0): got[1, "insights", 0].invalid_reason, (1, "insights", 1): "duplicate_interpretation", (1, "shifts", 0): None,
        (1, "shifts", 1): "invalid_chronology", (1, "open_questions", 0): "invalid_evidence_ref", (2, "insights", 0): None,
    }
    assert got[1, "themes", 0].distinct_session_count == 2 and got[1, "open_questions", 0].distinct_session_count is None
    assert got[1, "shifts", 0].support_type == "direct" and got[1, "themes", 0].support_type == "cross_session_interpretation"
    assert {r.review_id for r in review.metrics(judged).collect()} == {1, 2}
    assert review.evidence_rows(judged).count() == sum(len(r.evidence) for r in got.values())
    assert {(r.review_id, r.section): (r.visible, r.hidden_hard) for r in review.shown(judged).collect()}[1, "shifts"] == (1, 1)


def test_refs_keep_their_first_place(spark):
    r = one(spark, review.ordered_refs(F.lit([" S02:M001:E01 ", "", "M1"]), F.lit(None).cast("array<string>"), F.lit(["S01:M001:E01", "M1"])).alias("a"))
    assert r.a == ["S02:M001:E01", "M1", "S01:M001:E01"]
    assert one(spark, review.ref_sessions(F.lit(r.a)).alias("s")).s == ["S02", "S01"]


def test_admission_decisions_are_checked_in_order(spark):
    cands = spark.createDataFrame([("C01", 0), ("C02", 1)], "ref string, pos int")

    def fail(*rows):
        got = admission.admission_failure(cands, spark.createDataFrame([(r, i, d, w) for i, (r, d, w) in enumerate(rows)], "candidate_ref string, pos int, decision string, reason_code string")).collect()
        return tuple(got[0]) if got else None

    good = ("C01", "admit", "stable_topic")
    assert fail(good, ("C02", "reject", "pii")) is None
    assert fail(good) == ("missing_candidate_ref", "C02")
    assert fail(good, good, ("X", "admit", "pii")) == ("duplicate_candidate_ref", "C01")
    assert fail(("X", "admit", "pii"), good) == ("unknown_candidate_ref", "X")
    assert fail(("C01", "maybe", "pii")) == ("invalid_decision", "C01")
    assert fail(("C01", "admit", "nice")) == ("invalid_reason_code", "C01")
    assert fail(("C01", "admit", "pii")) == ("invalid_decision_reason", "C01")


def test_evidence_without_text_is_dropped(spark):
    c = spark.createDataFrame([("C1", [("s", "M001:E01", "d", "old")]), ("C2", [("s", "M009:E01", "d", "old")]), ("C3", [])], "ref string, representative_evidence array<struct<session_id:string,evidence_ref:string,occurred_at:string,short_text:string>>")
    texts = spark.createDataFrame([("s", "M001:E01", " new  text "), ("s", "M009:E01", " ")], "session_id string, evidence_ref string, text string")
    got = admission.resolved_evidence(c, texts)
    assert {r.ref: [e.short_text.strip() for e in r.representative_evidence] for r in got.collect()} == {"C1": ["new text"], "C2": [], "C3": []}
    assert tuple(admission.evidence_integrity(got).first()) == (3, 1, 2)
    judged = spark.createDataFrame([("A", "C1", 0, "admit"), ("A", "C2", 1, "defer")], "canonical_label string, candidate_ref string, pos int, decision string")
    marks = spark.createDataFrame([("A",), ("B",)], "label string")
    assert {r.label: (r.decision, r.found) for r in admission.important_decisions(judged, marks).collect()} == {"A": ("defer", True), "B": (None, False)}


def test_review_candidates_and_their_text(spark):
    reviews = spark.createDataFrame([(1, "sum")], "review_id int, summary string")
    items = spark.createDataFrame([(1, "shifts", 0, "hidden", False), (1, "shifts", 1, "seen", None), (1, "themes", 0, "theme", True)], "review_id int, section string, pos int, text string, semantic_valid boolean")
    got = context_pack.review_candidates(reviews, items, {"shifts": "SHIFT", "themes": "THEME"}, "P", "Q")
    assert {r.ref: (r.type, r.text) for r in got.collect()} == {"C:PROJECT_NAME": ("current_context", "P"), "C:CORE_PURPOSE": ("current_context", "Q"), "R:SUMMARY": ("summary", "sum"), "R:SHIFT:02": ("shift", "seen"), "R:THEME:01": ("theme", "theme")}
    text = context_pack.candidate_text(got.where("ref LIKE 'R:SH%'").withColumn("before", F.lit("old")), ["ref"]).first().candidate_text
    assert text == "[R:SHIFT:02] type=shift support=confirmed\nseen\nbefore: old"


def test_labels(spark):
    r = one(
        spark, L.support_label(F.lit("openQuestion"), F.lit("direct")).alias("a"), L.support_label(F.lit("nextQuestion"), F.lit("direct")).alias("b"), L.support_label(F.lit("theme"), F.lit("x")).alias("c"), L.evidence_metric(F.lit(1), F.lit(8), F.lit(0.125)).alias("d"),
        L.evidence_metric(F.lit(0), F.lit(0), F.lit(0.0)).alias("e"), L.interpretation_metric(F.lit(None), F.lit(0), F.lit(None)).alias("f"), L.question_preview(F.lit(" " + "x" * 60), "none").alias("g"), L.question_preview(F.lit(None), "none").alias("h"), L.relation_label(F.lit("contrast")).alias("i"),
        L.kind_label(F.lit("shift")).alias("j"), L.spotlight_label(F.lit("?")).alias("k"),
    )
    assert (r.a, r.b, r.c, r.d, r.e) == (L.OPEN_DIRECT, None, None, "根拠 1/8（13%）", None)
    assert r.f == "横断解釈 0/0（0%）" and r.g == "x" * 48 + "…" and r.h == "none" and r.i == "対比" and r.j == "変化" and r.k is None


def test_pilot(spark):
    from threadloom.plans import pilot

    texts = [("o", "s1", 0, "user", "Bouldering is what I like most of all."), ("o", "s1", 1, "assistant", "Good to hear."), ("o", "s1", 2, "user", "A chess club meets on Fridays here."), ("o", "s2", 0, "user", "More Bouldering with friends this week."), ("o", "s3", 0, "user", "Not covered at all by anyone.")]
    c = "array<struct<action:string,surface_form:string,existing_ref:string>>"
    new = lambda s: [{"action": "new", "surface_form": s, "existing_ref": None}]
    notes = [("o", "s1", "M001:E01", 0, "extracted", new("Bouldering")), ("o", "s1", "M003:E01", 1, "extracted", new("tennis")), ("o", "s2", "M001:E01", 0, "extracted", new("Bouldering"))]
    p = pilot.run(
        spark.createDataFrame(texts, "owner string, session_id string, turn int, role string, content string"), spark.createDataFrame([("o", "s1", "2026-01-01"), ("o", "s2", "2026-01-02"), ("o", "s3", "2026-01-03")], "owner string, session_id string, occurred_at string"),
        spark.createDataFrame(notes, f"owner string, session_id string, evidence_ref string, pos int, disposition string, concepts {c}"),
    )
    assert [(r.session_id, r.reason) for r in p.failures.collect()] == [("s3", "missing_unit")]
    assert sorted((r.session_id, r.resolved_as or "", r.reason or "") for r in p.outcomes.collect()) == [("s1", "", "surface_not_in_unit"), ("s1", "new", ""), ("s2", "match", "")]
    got = p.candidates.collect()
    assert [(r.ref, r.occurrence_count, r.distinct_session_count, r.first_seen_at, r.last_seen_at) for r in got] == [("o:C01", 2, 2, "2026-01-01", "2026-01-02")]
    assert {r.reason: r.n for r in pilot.reasons(p.outcomes).collect()} == {"surface_not_in_unit": 1}
    calls = spark.createDataFrame([("o", 5, None, 5), ("o", None, None, 2)], "owner string, input_tokens int, output_tokens int, total_tokens int")
    t = pilot.totals(p, calls).first()
    assert (t.processed_units, t.failed_sessions, t.match, t.new, t.rejected, t.occurrences, t.input_tokens, t.output_tokens, t.total_tokens) == (3, 1, 1, 1, 1, 2, 5, None, 7)
    assert [(r.ref, r.occurrence_count, r.distinct_session_count) for r in p.concepts.collect()] == [("o:C01", 2, 2)]


def test_text_containment(spark):
    long = "".join(chr(0x4E00 + i * i % 5000) for i in range(300))
    texts = [long, long, long[40:280], long[:30], "😀" + long[100:200], long[100:200], "a", "ab", "xaby", "a" * 90, "a" * 40, "", None, "abcdefghijklmnopqrstuvwxyz", "bcdefghijklmnopqrstuvwx", "cdefghijklmnopqrstuvwxyz", long[:30]]
    given = list(enumerate(texts, 1)) + [(1, long)]
    got = sorted(tuple(r) for r in containment.text_containment(spark.createDataFrame(given, "id long, k string"), "id", "k").collect())
    first = {}
    for i, t in given:
        first.setdefault(t, i)
    keys = {t: i for t, i in first.items() if t}
    want = {("contained", i, j) for a, i in keys.items() for b, j in keys.items() if a != b and a in b} | {("equal", i, first[t]) for i, t in given if t and i != first[t]}
    assert got == sorted(want)


def test_near_duplicate_documents_have_no_length_limit(spark, tmp_path):
    words = " ".join(f"word{i}、" for i in range(100))
    spark.createDataFrame([(1, words), (2, words.replace("、", "")), (3, words[80:600]), (4, "other")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {tuple(r) for r in queries.near_duplicate_documents(spark, str(tmp_path)).collect()}
    assert got == {("equal", 2, 1), ("contained", 3, 1)}


def test_short_texts_are_looked_for_by_their_first_characters(spark):
    text = "".join(chr(97 + i * i * 7 % 26) for i in range(60)) + "aaaa\0é😀bbbb" + "ab" * 20
    texts = [text, *(text[i : i + n] for n in range(1, 31) for i in (0, 3, 40, len(text) - n)), *("x" + text[7 : 7 + n] for n in range(1, 26))]
    texts = list(dict.fromkeys(texts))
    got = sorted((r.inner_id, r.outer_id) for r in containment.text_containment(spark.createDataFrame(list(enumerate(texts)), "id long, k string"), "id", "k").collect())
    assert got == sorted((i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i != j and a in b)
    # however many lengths short texts have, few are hashed at every place of all texts
    assert len({containment._head(n) for n in range(1, containment.GRAM)}) <= 4


def test_keys_of_containment_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def key(text):
        made.add(1)
        return text

    df = spark.createDataFrame([(i, f"text {i} " * 9) for i in range(7)], "id long, text string").withColumn("k", key.asNondeterministic()("text"))
    assert containment.text_containment(df, "id", "k").count() == 0
    assert made.value == 7


def test_label_rules_take_long_texts(spark):
    han, u = "[\\p{IsHan}\\p{IsKatakana}A-Za-z0-9]{2,}", "(?U)"
    compound = "[×↔⇔]|(?i:(^|\\s)vs(\\s|$))|" + han + "と" + han
    label = ["今日", " 今 日\n", "A vs B", "vs", "xVs\tvS", "canvas vs", "犬と猫", "犬猫と猫犬", "ab1とcd", "aとbc", "×", "田中さん", "皆さん", "田中さんと予定", "さん", "予定", "短い。", "忘れたのに言わないこと", "散歩すること\n", "しんどい状況", "", " ", "気持ち", "設計したい欲求", "Ab C", "今後確認\u3000する。", "a \x85", None]
    long = [" " * 700 + "今日", "x" + " " * 700, " \n" * 400 + "a  b" * 90, "田中さん" * 300, "word " * 300 + "すること", "言葉" * 200 + "皆さん"]
    df = spark.createDataFrame([(x,) for x in label + long], "x string")
    x = F.col("x")
    key = T.ascii_lower(F.regexp_replace(x, u + T.SPACE, ""))
    found = F.regexp_extract_all(x, F.lit(f"{u}([^\\s、。，]{{1,12}}{T.HONORIFIC})"), 1)
    person = F.size(F.array_except(found, F.array(*map(F.lit, T.HONORIFIC_ALLOWED)))) > 0
    lengthy = (F.length(x) > 16) | x.rlike("[。！？]") | x.rlike("(のに|こと)$") & (F.length(x) > 8)
    squeezed = F.regexp_replace(F.regexp_replace(x, f"{u}^{T.SPACE}+|{T.SPACE}+\\z", ""), f"{u}{T.SPACE}+", " ")
    rules = [
        (T.is_compound(x), x.rlike(compound)), (T.is_denied(x), key.isin(T.DENIED_CONCEPTS)), (T.is_honorific(x), x.rlike(f"{T.HONORIFIC}$") & ~x.isin(T.HONORIFIC_ALLOWED)), (T.has_honorific(x), person), (T.is_long_clause(x), lengthy),
        (T.is_episodic(x), x.rlike(T.EPISODIC) | person & x.rlike(T.EPISODIC_WITH_PERSON)), (T.is_broad(x), key.isin(T.BROAD_SURFACES)), (T.is_generic_surface(x), key.isin(T.GENERIC_SURFACES)), (T.is_adjective(x), key.isin(T.ADJECTIVES)), (T.is_vague_idea(x), key.isin("", *T.VAGUE_IDEAS)),
        (T.is_clause_like(x), lengthy | (F.length(x) >= 5) & x.endswith("こと") | (F.length(x) >= 8) & x.endswith("欲求") | (F.length(x) >= 6) & x.rlike(T.CLAUSE_TAIL)), (T.concept_key(x), key), (T.squeeze(x), squeezed), (T.shorten(x), F.substring(squeezed, 1, 80)),
    ]
    for i, (got, want) in enumerate(rules):
        assert df.select(got).collect() == df.select(want).collect(), i
    pair = spark.createDataFrame([("ab " * 150 + "xyz", "xyz"), ("ab " * 150 + "xyz", "q"), ("ab" * 150 + "xyz", "ab" * 150 + "q")], "a string, b string")
    assert [tuple(r) for r in pair.select(T.is_divergent(F.col("a"), F.col("b")), T.is_over_general(F.col("a"), F.col("b"))).collect()] == [(False, True), (True, False), (False, False)]
    # each place of a long word was tried up to the word's end
    start = time.monotonic()
    assert spark.range(1).select(F.repeat(F.lit("a"), 400_000).alias("x")).select(T.candidate_reason(x)).first()[0] is None
    assert time.monotonic() - start < 20


def test_bare_texts(spark):
    space = "".join(c for c in map(chr, range(0x10000)) if not 0xD800 <= ord(c) < 0xE000)
    df = spark.createDataFrame([(space,), ("a。b、 c．d，\n\te\u2003f😀",), ("",), (None,)], "x string")
    x = F.col("x")
    want = df.select(F.regexp_replace(x, "(?U)" + T.SPACE, "").alias("c"), F.regexp_replace(x, "(?U)" + T.SPACE + "|[。、．，]", "").alias("b")).collect()
    assert df.select(T.compact(x).alias("c"), T.bare(x).alias("b")).collect() == want


def test_long_branches(spark):
    long = [("a", i, i - 1, i == 300) for i in range(301)]
    others = [("b", 1, 2, True), ("b", 2, 3, False), ("b", 3, 1, False), ("c", 5, 4, True), ("d", 1, None, False), ("d", 2, 1, True), ("d", 2, 1, True), ("d", 3, 1, True), ("e", 1, None, False)]
    got = sorted(tuple(r) for r in export.branch_by_joins(spark.createDataFrame(long + others, "conv string, node int, parent int, is_current boolean")).collect())
    want = [("a", i, 300 - i) for i in range(301)] + [("b", 1, 0), ("b", 2, 1), ("b", 3, 2), ("c", 5, 0), ("d", 1, 1), ("d", 1, 1), ("d", 2, 0), ("d", 3, 0)]
    assert got == want


def test_quotes_of_any_length_are_found(spark, tmp_path):
    docs = ["a short text", "abc", "nothing of it 😀 here", "exactly twelve and more", None, "", "exactly tw", "abc abc"]
    quotes = ["abc", " abc ", "short", "exactly twelve and", "exactly tw", "a", "😀", "exactly twel", "here and", " ", None, "exactly twelve and more"] + ["exactly twelve and more than that"[:n] for n in range(1, 12)]
    for name, id_, given in (("documents", "doc_id", docs), ("benchmark", "item_id", quotes)):
        spark.createDataFrame(list(enumerate(given)), f"{id_} long, text string").write.parquet(str(tmp_path / f"{name}.parquet"))
    want = sorted((i, j) for i, q in enumerate(quotes) for j, d in enumerate(docs) if q and d and q.strip() and q.strip() in d)
    assert sorted(tuple(r) for r in queries.quote_grounding(spark, str(tmp_path)).collect()) == want


def test_a_chain_of_refs_is_decided_by_change(spark):
    """200 actions that each name the concept of the one before; a wrong one in the middle moves all that follow."""
    actions = lambda bad: [(p, p // 10, f"u{p}", "new" if p == 1 else "match", f"word{p}", "C99" if p == bad else f"C{p - 1:02d}", None) for p in range(1, 201)]
    for bad in (None, 100):
        rows, trace = actions(bad), []
        df = spark.createDataFrame([("r", "s", b, p, u, a, x, e, g) for p, b, u, a, x, e, g in rows], ACTIONS)
        out = concepts.resolve(df, ["reg"], trace=trace).collect()
        assert sorted((r.pos, r.status, r.concept_ref) for r in out) == sorted(((p, s, c) for p, s, c in _fold(rows)), key=lambda x: (x[0], x[1], x[2] or ""))
        assert trace[0] == 200 and len(trace) <= 5 and all(n <= 199 for n in trace[1:])
    # only units that hold a moved key or ref are decided again
    calm = [("q", "s", 0, p, f"u{p}", "new", f"calm{p}", None, None) for p in range(1000)]
    trace = []
    concepts.resolve(spark.createDataFrame([("r", "s", b, p, u, a, x, e, g) for p, b, u, a, x, e, g in actions(None)] + calm, ACTIONS), ["reg"], trace=trace).count()
    assert trace[0] == 1200 and sum(trace[1:]) < 1000


def test_normal_forms_of_all_characters(spark):
    """Every character by itself and after letters: as unicodedata has it, and calm ones aren't sent to Python."""
    import unicodedata

    chars = [chr(i) for i in range(0x20000) if not 0xD800 <= i < 0xE000]
    texts = [(x,) for c in chars for x in (c, "aか한" + c)] + [("plain ASCII text",), ("日本語のテキスト、です。",), ("",), (None,)]
    df = spark.createDataFrame(texts, "t string").repartition(4)
    got = df.select("t", T.nfkc(F.col("t")).alias("k"), T.nfc(F.col("t")).alias("c"), T.unusual(F.col("t"), "NFKC").alias("u"), T.unusual(F.col("t"), "NFC").alias("v")).collect()
    assert all(r.k == (r.t and unicodedata.normalize("NFKC", r.t)) and r.c == (r.t and unicodedata.normalize("NFC", r.t)) for r in got)
    assert {r.t: (r.u, r.v) for r in got if r.t in ("plain ASCII text", "日本語のテキスト、です。", "é")} == {"plain ASCII text": (None, None), "日本語のテキスト、です。": (None, None), "é": ("é", None)}


def test_concepts_take_no_python_workers(spark):
    """Forms of texts, and all that is done to resolve concepts by them, run in the JVM."""
    df = spark.createDataFrame([("Ｇｏｏｄ\U0001ccd6é\U0001ccd7ｱﾞ",), (None,)], "t string")
    got = df.select(T.nfkc(F.col("t")).alias("k"), T.nfc(F.col("t")).alias("c"))
    assert [tuple(r) for r in got.collect()] == [("Good\U0001ccd6é\U0001ccd7ア\u3099", "Ｇｏｏｄ\U0001ccd6é\U0001ccd7ｱﾞ"), (None, None)]
    plan = df.select(T.concept_key(F.col("t")), T.concept_label(F.col("t")), T.quote_text(F.col("t")), T.quote_found(T.quote_text(F.col("t")), T.quote_text(F.col("t"))))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_units_of_a_batch_are_few_objects_at_a_time(monkeypatch):
    import tracemalloc

    import pyarrow as pa

    batch = pa.array(["One sentence of some length here. " * 20, None, ""] * 1000)
    want = [units.split_text(c or "") for c in batch.slice(0, 3).to_pylist()]
    tracemalloc.start()
    got = units.units_of.func(batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 3000 and got.slice(0, 3).to_pylist() == want
    assert peak < 2 << 20


def test_pairs_of_calm_characters_do_not_compose():
    import re
    import unicodedata

    for form, pattern in T._UNUSUAL.items():
        odd = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: "\\U%08x" % int(m[1], 16), pattern))
        calm = [chr(i) for i in range(0x10000) if not 0xD800 <= i < 0xE000 and not odd.search(chr(i))]
        assert len(calm) > 20_000 and all(unicodedata.is_normalized(form, c) and not unicodedata.combining(c) for c in calm)
        # what can be the second of a composition is never calm
        second = {d[1] for i in range(0x10000) if not 0xD800 <= i < 0xE000 and len(d := unicodedata.normalize("NFD", chr(i))) > 1}
        assert not second & set(calm)


def test_containment_of_keys_with_a_common_piece(spark, monkeypatch):
    keys = [(i, "common") for i in range(40)] + [(100 + i, f"xx{i}common{i}yy") for i in range(40)] + [(200, "mm"), (201, "c"), (202, "mon")]
    df = spark.createDataFrame(keys, "id int, k string")
    want = sorted((i, j) for i, a in keys for j, b in keys if i != j and len(a) >= 2 and a in b)
    for together in (4096, 3):
        monkeypatch.setattr(joins, "TOGETHER", together)
        pairs = joins.key_containment(df, "id", "k")
        assert sorted((r.inner_id, r.outer_id) for r in pairs.collect()) == want
