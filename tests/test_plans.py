"""Plans and sinks, with rows worked out by hand."""

import json

from pyspark.sql import functions as F

from threadloom.operators import evidence as E
from threadloom.operators import findings, lists, units
from threadloom.plans import admission, analysis, context_pack, observations, review
from threadloom.sources import payloads, sinks
from threadloom.streaming import stream_message_stats


def _ev(session="s1", role="user", ok=True, reason=None, message="m1", day="2026-01-01"):
    return ("M001:E01", "quote", ok, reason, role, message, session, day)


def test_inserts_tell_why_rows_are_skipped(spark, tmp_path):
    path = str(tmp_path / "concepts")
    rows = spark.createDataFrame([(1, "a", None), (1, "b", None), (2, "c", "generic_term"), (3, "d", None)], "id int, x string, why string")
    got = sorted(((r.id, r.skip_reason) for r in sinks.insert_with_reasons(rows, path, ["id"], "why").collect()), key=str)
    assert got == [(1, "repeated"), (1, None), (2, "generic_term"), (3, None)]
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 3]
    again = sinks.insert_with_reasons(rows, path, ["id"], "why").where("skip_reason = 'already_there'").count()
    assert again >= 2 and spark.read.parquet(path).count() == 2


def test_tables_are_written_together_once(spark, tmp_path):
    item = f"struct<item_id:int,kind:string,evidence:array<{E.EVIDENCE}>>"
    a = spark.createDataFrame([("a1", "s1", [(1, "fact", [_ev(), _ev(message=None)]), (2, "insight", [])])], f"analysis_id string, session_id string, items array<{item}>")
    assert sinks.write_together(sinks.analysis_tables(a), str(tmp_path)) == {"evidences": 1, "session_status": 1, "analyses": 1}
    assert sinks.write_together(sinks.analysis_tables(a), str(tmp_path)) == {"evidences": 0, "session_status": 0, "analyses": 0}
    p = spark.createDataFrame([("p1", ["s1", "s2", "s1"])], "pack_id string, session_ids array<string>")
    assert sinks.write_together(sinks.bridge_tables(p, "pack_id", "session_ids", "pack"), str(tmp_path)) == {"pack_sessions": 2, "packs": 1}


def test_a_session_is_parsed_again(spark, tmp_path):
    s = spark.createDataFrame([("s1", "User: hi\nAssistant: hello"), ("s2", "")], "session_id string, raw_content string")
    status, m = sinks.parsed_sessions(s)
    assert {r.session_id: r.status for r in status.collect()} == {"s1": "parsed", "s2": "draft"} and m.count() == 2
    path = str(tmp_path / "messages")
    sinks.reparse(s, path)
    sinks.reparse(s.where("session_id = 's1'").withColumn("raw_content", F.lit("User: one")), path)
    assert [(r.role, r.content) for r in spark.read.parquet(path).collect()] == [("user", "one")]


def test_reports(spark, tmp_path):
    from pyspark.sql.types import ArrayType, StringType, StructField, StructType

    schema = StructType([StructField("concepts", ArrayType(StringType())), StructField("notes", ArrayType(StringType()))])
    (tmp_path / "r.json").write_text(json.dumps({"concepts": ["a"]}))
    assert payloads.read_report(spark, str(tmp_path / "r.json"), schema, ["concepts"]).first().notes == []
    sinks.write_report(spark.createDataFrame([(1,)], "n int"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().n == 1
    labels = spark.createDataFrame([("C1", "A"), ("C1", "B"), (" ", "A"), ("C2", "X")], "candidate_ref string, class string")
    assert {(r.candidate_ref, r.reason) for r in payloads.label_failures(labels).collect()} == {(" ", "blank_candidate_ref"), ("C2", "invalid_class"), ("C1", "duplicate_candidate_ref")}


def test_provisional_matches_give_findings(spark):
    rows = spark.createDataFrame([("C1", "気持ち", "不安", "M001:E01"), ("C2", "りんご", "赤いりんご", "M001:E02")], "concept_ref string, surface_form string, canonical_label string, evidence_ref string")
    got = {(r.kind, r.concept_ref) for r in findings.of_provisional(rows).collect()}
    assert got == {("semantic_provisional_match", "C1"), ("semantic_lexical_gap", "C1"), ("broad_surface_specific_canonical", "C1"), ("semantic_provisional_match", "C2"), ("surface_canonical_grain_mismatch", "C2")}


def test_admission_texts_and_usage(spark):
    rep = "array<struct<session_id:string,evidence_ref:string,occurred_at:string,short_text:string>>"
    c = spark.createDataFrame([("C1", "Apple", 2, 1, "2026-01-01", "", ["s"], [], [("s", "M001:E01", "d", "short")]), ("C2", "B", 0, 0, "", "", [], ["long_label"], [])], f"ref string, canonical_label string, occurrence_count long, distinct_session_count long, first_seen_at string, last_seen_at string, session_ids array<string>, suspicious_flags array<string>, representative_evidence {rep}")
    got = {r.ref: r.text for r in admission.candidate_lines(c).collect()}
    assert got["C1"] == "## C1\ncanonicalLabel: Apple\noccurrenceCount: 2\ndistinctSessionCount: 1\nfirstSeenAt: 2026-01-01\nlastSeenAt: （なし）\nsessionIds: s\nsuspiciousFlags: （なし）\nrepresentativeEvidence:\n- [s][M001:E01] short"
    assert got["C2"].endswith("suspiciousFlags: long_label\nrepresentativeEvidence:\n- （なし）")
    assert [tuple(r) for r in admission.duplicate_refs(c.union(c.limit(1))).collect()] == [("C1", "duplicate_candidate_ref")]
    names = "k int, input_tokens int, output_tokens int, total_tokens int"
    assert tuple(admission.merge_usage(spark.createDataFrame([(1, 5, 6, 7)], names), spark.createDataFrame([(1, None, 9, None)], names), "k").first()) == (1, 5, 9, 7)
    texts = spark.createDataFrame([("s", "M001:E01", "unit")], "session_id string, evidence_ref string, text string")
    out = admission.admit(c, texts, spark.createDataFrame([("C1", "admit", "stable_topic"), ("C2", "reject", "generic")], "candidate_ref string, decision string, reason_code string"))
    assert tuple(out["integrity"].first()) == (2, 1, 1) and {r.decision: r.refs for r in out["lists"].collect()} == {"admit": ["C1"], "reject": ["C2"]}


def test_review_from_refs(spark):
    m = spark.createDataFrame([(1, "m1", "I like it here."), (1, "m2", "I like it there.")], "review_id int, message_id string, content string")
    u = spark.createDataFrame([(1, "S01:M001:E01", "I like it here.", 0, 15, "user", "m1", "a", "2026-01-01"), (1, "S02:M001:E01", "I like it there.", 0, 16, "user", "m2", "b", "2026-01-02")], "review_id int, ref string, unit_text string, unit_start int, unit_end int, role string, message_id string, session_id string, occurred_at string")
    refs = ["S01:M001:E01", "S02:M001:E01"]
    rows = [(1, "themes", 0, "Liking", refs, None, None, None, None), (1, "shifts", 0, "From here to there", refs, None, None, refs[:1], refs[1:]), (1, "tensions", 0, "Both", refs, refs[:1], ["S09:M001:E01"], None, None)]
    items = spark.createDataFrame(rows, "review_id int, section string, pos int, text string, refs array<string>, side_a_refs array<string>, side_b_refs array<string>, before_refs array<string>, after_refs array<string>")
    got = {r.section: r.invalid_reason for r in review.run(items, spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "review_id int, session_id string, session_no int"), u, m).collect()}
    assert got == {"themes": None, "shifts": None, "tensions": "invalid_evidence_ref"}


def test_analysis_notes_and_payloads(spark):
    item = "struct<kind:string,subject:string,text:string,semantic_valid:boolean>"
    rows = [(1, 1, analysis.VERSION, "sum", [("fact", "user", "a", None), ("insight", None, "b", False), ("action", None, "c", True)] + [("fact", "", f"x{i}", True) for i in range(30)]), (1, 2, "old", "no", [])]
    notes = analysis.auxiliary_note(spark.createDataFrame(rows, f"review_id int, session_no int, prompt_version string, summary string, items array<{item}>"), ["review_id", "session_no"]).collect()
    assert len(notes) == 1 and notes[0].note.startswith(f"promptVersion: {analysis.VERSION}\nsummary: sum\n- [fact/user] a\n- [action] c\n- [fact] x0") and notes[0].note.count("\n") == 21
    a = spark.createDataFrame([("s", 2, "fact", "user", "t", [_ev()]), ("s", 1, "decision", "user", "d", [_ev(role="assistant")])], f"session_id string, item_id int, kind string, subject string, text string, evidence array<{E.EVIDENCE}>")
    reason = E.support_reason(F.col("kind"), F.col("subject"), F.col("evidence"))
    a = a.withColumns({"invalid_reason": reason, "semantic_valid": reason.isNull(), "unsupported_claim": E.unsupported_claim(F.col("kind"), F.col("evidence"))})
    p = analysis.payloads(a, spark.createDataFrame([("s", "sum")], "session_id string, summary string"), ["session_id"])
    r = p.withColumn("q", analysis.quality(F.col("validated_count"), F.col("evidence_count"), F.col("validation_rate"), F.col("semantic_valid_count"), F.col("semantic_item_count"), F.col("semantic_validation_rate"))).first()
    assert [(i.item_id, i.semantic_valid, i.unsupported_claim) for i in r["items"]] == [(1, False, True), (2, True, False)] and r.q == "根拠 2/2（100%） / 意味的根拠 1/2（50%）"


def test_pack_candidates_have_what_their_section_has(spark):
    r = spark.createDataFrame([(1, "sum")], "review_id int, summary string")
    items = spark.createDataFrame([(1, "shifts", 0, "t", None, "now so", "was", "is", None, None, None), (1, "hypotheses", 0, "h", True, None, None, None, None, "why", "try")], "review_id int, section string, pos int, text string, semantic_valid boolean, interpretation string, before string, after string, side_a string, rationale string, validation_idea string")
    a = spark.createDataFrame([(1, 1, 0, "decision", "user", "do it", [_ev()], False, True, "s1", "One", "2026-01-01")], f"review_id int, session_no int, pos int, kind string, subject string, text string, evidence array<{E.EVIDENCE}>, unsupported_claim boolean, semantic_valid boolean, session_id string, session_title string, occurred_at string")
    c = context_pack.candidates(r, items, a, "P", "Q")
    got = {x.ref: x for x in c.collect()}
    assert (got["R:SHIFT:01"].text, got["R:SHIFT:01"].before, got["R:SHIFT:01"].after) == ("now so", "was", "is") and got["R:HYPOTHESIS:01"].rationale == "why" and (got["D:S01:01"].session_title, got["D:S01:01"].occurred_at) == ("One", "2026-01-01")
    text = context_pack.source_checks(context_pack.candidate_text(c, ["ref"])).first()
    assert "validationIdea: try" in text.candidate_text and not text.too_long
    md = context_pack.markdown(context_pack.select(spark.createDataFrame([(1, 0, "R:SHIFT:01"), (1, 1, "R:HYPOTHESIS:01")], "review_id int, pos int, ref string"), c), spark.createDataFrame([(1, "")], "review_id int, question string"), "U", "P", "Q").first().markdown
    assert "* now so\n  * 以前：was\n  * 現在：is" in md and "* 【仮説】h\n  * なぜそう考えられるか：why\n  * 検証案：try" in md
    assert context_pack.pack_title(spark.createDataFrame([(1, "2026-01-01"), (1, "2026-01-05")], "review_id int, occurred_at string")).first().title == "Context Pack 2026/01/01 - 2026/01/05"


def test_records_that_are_not_valid_are_left_out(spark):
    good = {"interpretation": "i", "before": "b", "after": "a"}
    rows = [("1", "shift", json.dumps(good), "x"), ("2", "shift", "{}", None), ("3", "other", json.dumps(good), None), ("4", "tension", json.dumps({"text": "t", "sideA": {"text": "A"}, "supportType": "hypothesis"}), "direct"), ("5", "connection", "{", None), ("6", "connection", json.dumps({"text": "t", "semanticValid": False}), None), ("7", "connection", json.dumps({"text": "c", "relationType": "contrast"}), "direct")]
    df = spark.createDataFrame(rows, "id string, kind string, payload string, support_type string").withColumns({c: F.lit(c) for c in ("title", "body", "first_seen_at", "last_seen_at", "review_id")})
    got = observations.from_records(df)
    assert {r.id: r.support_type for r in got.collect()} == {"1": None, "4": "hypothesis", "7": "direct"}
    cards = {r.id: r for r in observations.cards(got).collect()}
    assert cards["1"].shift.before == "b" and cards["1"].tension is None and cards["4"].tension.side_a == "A" and cards["7"].connection.relation_label == "対比"


def test_lists(spark):
    df = spark.createDataFrame([(1, "2026-01-02", None), (2, None, "x"), (3, "2026-01-02", "z")], "id int, seen string, detected string")
    assert [r.id for r in lists.newest_first(df, "seen", "detected").collect()] == [3, 1, 2]
    assert [r.id for r in lists.oldest_first(df, "id").limit(2).collect()] == [1, 2]
    assert lists.where_given(df, id=None, detected="").count() == 3 and lists.where_given(df, id=2).count() == 1
    bridge = spark.createDataFrame([("r", 1), ("r", 3)], "review string, id int")
    assert sorted(r.id for r in lists.children(bridge, df, "review", "id").collect()) == [1, 3]


def test_numbers_and_attachments_of_transcripts(spark):
    s = units.numbered_sessions(spark.createDataFrame([(1, "b", "2026-01-01", "1"), (1, "a", "2026-01-01", "1"), (1, "c", "2025-01-01", "9")], "review_id int, id string, occurred_at string, created_at string"))
    assert {r.id: r.session_no for r in s.collect()} == {"c": 1, "a": 2, "b": 3}
    m = spark.createDataFrame([("s", 1, "M001", "user", True, "one"), ("s", 2, "M002", "assistant", False, "")], "s string, message_no int, message_ref string, role string, attached boolean, content string")
    u = spark.createDataFrame([("s", 1, 1, "M001:E01", "user", "one")], "s string, message_no int, unit_no int, ref string, role string, unit_text string")
    assert units.labelled_transcript(m, u, ["s"]).first().transcript == "[USER MESSAGE M001]\n\n[M001:E01][USER]\none\n\n（添付ファイルあり）\n\n[ASSISTANT MESSAGE M002]"
    assert units.plain_transcript(m, ["s"]).first().transcript == "[S1:M001][USER]\none\n（添付ファイルあり）\n\n[S1:M002][ASSISTANT]\n"


def test_stream_of_message_stats(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", "2026-01-01 00:10:00"), ("a", "2026-01-01 00:20:00"), ("b", "2026-01-01 03:00:00")], "k string, at string").select("k", F.to_timestamp("at").alias("at")).write.parquet(src)
    q = stream_message_stats(spark.readStream.schema("k string, at timestamp").parquet(src), "at", "k").writeStream.format("memory").queryName("stats").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.k, r.n) for r in spark.table("stats").collect()} == {("a", 2), ("b", 1)}
