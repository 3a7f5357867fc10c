"""Guards of review items: each gives a struct (valid, reason, guard_type). The order of the rules decides the reason."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from .evidence import corpus, first_day, has_invalid_ref, has_user, has_valid, sessions_of


def _verdict(rules: list[tuple[Column, str | Column, str]], otherwise: str) -> Column:
    """The first rule that holds: (condition, reason, guard type)."""
    reason, guard = F.when(F.lit(False), F.lit(None).cast("string")), F.when(F.lit(False), F.lit(None).cast("string"))
    for cond, why, kind in rules:
        cond = F.coalesce(cond, F.lit(False))
        reason, guard = reason.when(cond, why), guard.when(cond, kind)
    return F.struct(reason.isNull().alias("valid"), reason.alias("reason"), guard.otherwise(otherwise).alias("guard_type"))


def _hard_quality(claim: Column, ev: Column) -> list:
    role = F.when(has_valid(ev), "evidence_role_mismatch").otherwise("missing_user_evidence")
    return [(T.leaps_domain(claim, corpus(ev)), "domain_leap", "hard"), (T.asserts_inner_state(claim) & ~has_user(ev), role, "hard")]


def _soft_quality(claim: Column, hypothesis: bool = False) -> list:
    rules = [(T.is_psychological(claim), "unrelated_interpretation", "interpretation"), (T.is_generic_theme(claim), "generic_interpretation", "interpretation")]
    return rules + [(T.is_exaggerated(claim) | T.is_unverifiable(claim), "unsupported_exaggeration", "interpretation")] * hypothesis


def _invalid(*evs: Column) -> list:
    return [(has_invalid_ref(ev), "invalid_evidence_ref", "hard") for ev in evs]


def _few(ev: Column, kind: str) -> tuple:
    return F.size(sessions_of(ev)) < 2, "insufficient_distinct_sessions", kind


def theme(claim: Column, ev: Column) -> Column:
    return _verdict([*_invalid(ev), _few(ev, "hard"), *_hard_quality(claim, ev), *_soft_quality(claim)], "interpretation")


def _one_session(a: Column, b: Column) -> Column:
    a, b = sessions_of(a), sessions_of(b)
    return (F.size(a) == 1) & (F.size(b) == 1) & F.arrays_overlap(a, b)


def tension(claim: Column, ev: Column, side_a: Column | None = None, side_b: Column | None = None) -> Column:
    """Also of insights across sessions, which have no sides."""
    sides = []
    if side_a is not None:
        sides = [*_invalid(side_a, side_b), (_one_session(side_a, side_b), "insufficient_distinct_sessions", "interpretation")]
    return _verdict([*_invalid(ev), *sides, *_hard_quality(claim, ev), _few(ev, "interpretation"), *_soft_quality(claim)], "interpretation")


def hypothesis(claim: Column, ev: Column) -> Column:
    return _verdict([*_invalid(ev), *_hard_quality(claim, ev), _few(ev, "interpretation"), *_soft_quality(claim, True)], "interpretation")


def shift(before: Column, after: Column, session_order: Column | None = None) -> Column:
    """session_order: the review's session ids in order, which decides between sides of the same day."""
    a, b = sessions_of(before), sessions_of(after)
    day_a, day_b = first_day(before), first_day(after)
    late = day_a > day_b
    if session_order is not None:
        place = lambda ids: F.array_min(F.filter(F.transform(ids, lambda s: F.array_position(session_order, s)), lambda p: p > 0))
        late = late | (day_a == day_b) & (place(a) >= place(b))
    role = F.when(has_valid(before) & has_valid(after), "evidence_role_mismatch").otherwise("missing_user_evidence")
    return _verdict(
        [
            *_invalid(before, after),
            ((F.size(a) == 0) | (F.size(b) == 0), "insufficient_distinct_sessions", "hard"),
            (_one_session(before, after), "unsupported_cross_session_claim", "hard"),
            (late, "invalid_chronology", "hard"),
            (~has_user(before) | ~has_user(after), role, "hard"),
        ],
        "hard",
    )


def open_question(ev: Column) -> Column:
    return _verdict(_invalid(ev), "interpretation")


def next_question(text: Column, ev: Column) -> Column:
    return _verdict([*_invalid(ev), (T.is_weak_question(text), "weak_next_question", "interpretation")], "interpretation")


def duplicate_insight(verdict: Column, insight: Column, themes: Column) -> Column:
    """An insight that says what a valid theme of its review says is not valid, whatever else was found."""
    same = F.exists(F.coalesce(themes, F.array().cast("array<string>")), lambda t: T.near_duplicates(insight, t))
    other = F.struct(F.lit(False).alias("valid"), F.lit("duplicate_interpretation").alias("reason"), F.lit("interpretation").alias("guard_type"))
    return F.when(same, other).otherwise(verdict)
