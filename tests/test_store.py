"""Runs over several tables show as a whole, replace what they list and delete all that hangs on it."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from threadloom.sources.store import Store

SCHEMAS = {
    "sessions": "session_id string, title string", "messages": "session_id string, index int, text string", "analyses": "analysis_id string, session_id string",
    "evidences": "evidence_id string, analysis_id string, session_id string",
}
KEYS = {"sessions": ["session_id"], "messages": ["session_id", "index"], "analyses": ["analysis_id"], "evidences": ["evidence_id"]}
REFERENCES = [("sessions", "messages", "session_id"), ("sessions", "analyses", "session_id"), ("sessions", "evidences", "session_id"), ("analyses", "evidences", "analysis_id")]


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store", KEYS, {n: StructType.fromDDL(s) for n, s in SCHEMAS.items()}, REFERENCES)


def _rows(spark, name, rows):
    return spark.createDataFrame(rows, SCHEMAS[name])


def _seen(store, name):
    return sorted(map(tuple, store.read(name).collect()))


def test_a_run_that_fails_between_tables_shows_nothing(spark, store):
    s, m = _rows(spark, "sessions", [("a", "A"), ("b", "B"), ("b", "B2")]), _rows(spark, "messages", [("a", 0, "x"), ("b", 0, "y")])
    broken = m.withColumn("text", F.when(F.col("session_id") == "b", F.raise_error(F.lit("lost"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="lost"):
        store.commit("r1", {"sessions": s, "messages": broken})
    assert _seen(store, "sessions") == [] and _seen(store, "messages") == []
    assert store.commit("r1", {"sessions": s, "messages": m}) == {"sessions": 2, "messages": 2}
    assert store.commit("r1", {"sessions": s, "messages": m}) == {"sessions": 2, "messages": 2}  # told, not repeated
    assert _seen(store, "sessions") == [("a", "A"), ("b", "B")] and _seen(store, "messages") == [("a", 0, "x"), ("b", 0, "y")]
    assert store.commit("r2", {"sessions": s, "messages": m}) == {"sessions": 0, "messages": 0}


def test_sessions_are_replaced(spark, store, tmp_path):
    store.commit("r1", {"messages": _rows(spark, "messages", [("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z"), ("c", 0, "w")])})
    listed = spark.createDataFrame([("a",), ("b",)], "session_id string")
    store.replace("r2", "messages", "session_id", listed, _rows(spark, "messages", [("a", 0, "new")]))
    assert _seen(store, "messages") == [("a", 0, "new"), ("c", 0, "w")]
    store.commit("r3", {"messages": _rows(spark, "messages", [("b", 0, "again"), ("a", 0, "no")])})
    assert _seen(store, "messages") == [("a", 0, "new"), ("b", 0, "again"), ("c", 0, "w")]
    assert sorted(p.name for p in (tmp_path / "store").iterdir()) == ["deletions", "finished_runs", "messages"]


def test_cascade(spark, store):
    store.commit("r1", {
        "sessions": _rows(spark, "sessions", [("a", "A"), ("b", "B")]), "messages": _rows(spark, "messages", [("a", 0, "x"), ("b", 0, "y")]),
        "analyses": _rows(spark, "analyses", [("1", "a"), ("2", "b")]), "evidences": _rows(spark, "evidences", [("e1", "1", "b"), ("e2", "2", "a"), ("e3", "2", "b")]),
    })
    assert {tuple(r) for r in store.orphans().collect()} == {(p, c, 0) for p, c, _ in REFERENCES}
    gone = spark.createDataFrame([("a",), ("zz",)], "session_id string")
    assert store.cascade("d1", "sessions", gone) == {"sessions": 1, "messages": 1, "analyses": 1, "evidences": 2}
    assert _seen(store, "sessions") == [("b", "B")] and _seen(store, "analyses") == [("2", "b")] and _seen(store, "evidences") == [("e3", "2", "b")]
    assert store.cascade("d1", "sessions", gone) == {} and store.cascade("d2", "sessions", gone)["sessions"] == 0
    store.commit("r2", {"sessions": _rows(spark, "sessions", [("a", "back")])})
    assert _seen(store, "sessions") == [("a", "back"), ("b", "B")] and _seen(store, "messages") == [("b", 0, "y")]
