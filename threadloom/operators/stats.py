"""Counts and rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rate(part: Column, whole: Column, empty: float | None = 0.0) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(empty).cast("double"))


def message_stats(messages: DataFrame, keys: list[str], content: str = "content", role: str = "role") -> DataFrame:
    """Per session: user and assistant messages, and their characters."""
    return messages.where(F.col(role).isin("user", "assistant")).groupBy(*keys).agg(F.count("*").alias("message_count"), F.sum(F.length(content)).alias("char_count"))


def with_message_stats(sessions: DataFrame, messages: DataFrame, keys: list[str], **names: str) -> DataFrame:
    """Every session, with zero counts where it has no such message, and whether there is anything to analyse."""
    out = sessions.join(message_stats(messages, keys, **names), keys, "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("message_count", "char_count")})
    return out.withColumn("analyzable", F.col("message_count") > 0)


def evidence_stats(items: DataFrame, keys: list[str], evidence: str = "evidence") -> DataFrame:
    """Evidences of items (an array column of structs with `validated`), how many are valid, and their rate."""
    n, ok = F.sum(F.size(evidence)), F.sum(F.size(F.filter(evidence, lambda e: e["validated"])))
    out = items.groupBy(*keys).agg(F.coalesce(n, F.lit(0)).alias("evidence_count"), F.coalesce(ok, F.lit(0)).alias("validated_count"))
    return out.withColumn("validation_rate", rate(F.col("validated_count"), F.col("evidence_count")))


def semantic_stats(items: DataFrame, keys: list[str], valid: str = "semantic_valid") -> DataFrame:
    """Items with a verdict, and how many of them hold."""
    out = items.groupBy(*keys).agg(F.count(valid).alias("semantic_item_count"), F.count_if(F.col(valid)).alias("semantic_valid_count"))
    return out.withColumn("semantic_validation_rate", rate(F.col("semantic_valid_count"), F.col("semantic_item_count")))


def guard_stats(items: DataFrame, keys: list[str], guard: str = "guard_type", valid: str = "semantic_valid") -> DataFrame:
    """For hard and interpretation guards: items, valid ones, their rate and those left out."""
    aggs = []
    for g in ("hard", "interpretation"):
        mine = F.col(guard) == g
        aggs += [F.count_if(mine).alias(f"{g}_item_count"), F.count_if(mine & F.coalesce(F.col(valid), F.lit(False))).alias(f"{g}_valid_count")]
    out = items.groupBy(*keys).agg(*aggs)
    for g in ("hard", "interpretation"):
        n, ok = F.col(f"{g}_item_count"), F.col(f"{g}_valid_count")
        out = out.withColumns({f"{g}_validation_rate": rate(ok, n), f"{g}_excluded_count": n - ok})
    return out


def reason_histogram(rows: DataFrame, keys: list[str], reason: str, detail: str | None = None) -> DataFrame:
    """Rows for each reason, written reason or reason:detail."""
    name = F.concat_ws(":", reason, detail) if detail else F.col(reason)
    return rows.where(F.col(reason).isNotNull()).groupBy(*keys, name.alias("reason")).agg(F.count("*").alias("n"))


def zero_filled(histogram: DataFrame, names: list[str], column: str, count: str) -> DataFrame:
    """Every name with its count, 0 where it never came."""
    all_ = histogram.sparkSession.createDataFrame([(n,) for n in names], f"{column} string")
    return all_.join(histogram, column, "left").withColumn(count, F.coalesce(count, F.lit(0).cast("long")))


def concept_stats(occurrences: DataFrame, concept: str = "concept_ref", session: str = "session_id") -> DataFrame:
    return occurrences.groupBy(concept).agg(F.count("*").alias("occurrence_count"), F.countDistinct(session).alias("distinct_session_count"))


def date_span(rows: DataFrame, keys: list[str], day: str) -> DataFrame:
    """First and last day, and a label: one day, or a range."""
    out = rows.groupBy(*keys).agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"))
    slashed = lambda c: F.translate(c, "-", "/")
    return out.withColumn("label", F.when(F.col("first_day") == F.col("last_day"), slashed("first_day")).otherwise(F.concat(slashed("first_day"), F.lit(" - "), slashed("last_day"))))


def over_extraction(unique: Column, units: Column) -> Column:
    """12 concepts, or over 8 where they are at least half as many as the units."""
    return (unique >= 12) | (units > 0) & (unique > 8) & (unique / units >= 0.5)


def identity_diff(before: DataFrame, after: DataFrame, ref: str, values: list[str]) -> DataFrame:
    """One row: refs missing on either side, and values that differ for refs on both."""
    a = before.select(F.col(ref), F.struct(*values).alias("a"))
    b = after.select(F.col(ref), F.struct(*values).alias("b"))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    changed = [F.count_if(both & ~F.col(f"a.{v}").eqNullSafe(F.col(f"b.{v}"))).alias(f"{v}_changed") for v in values]
    return a.join(b, ref, "full").agg(F.count_if(F.col("b").isNull()).alias("only_before"), F.count_if(F.col("a").isNull()).alias("only_after"), *changed)


#: Goals of the admission policy; the first four are lower bounds, the others upper ones.
GOALS = {
    "class_a_admit_rate": 0.80, "class_d_reject_rate": 0.80, "admitted_ab_rate": 0.75, "important_recall": 6 / 7,
    "class_c_admit_rate": 0.15, "false_admission_rate": 0.25,
}


def calibration(judged: DataFrame, keys: list[str], decision: str = "decision", klass: str = "class") -> DataFrame:
    """Rates of decisions against classes A to D (null: unlabelled); a rate without cases is null. The share of A and B
    is of labelled admissions, that of false admissions of all."""
    d, k = F.col(decision), F.col(klass)
    n = lambda cond: F.count_if(cond)
    admitted = d == "admit"
    aggs = {"labelled": n(k.isNotNull()), "admitted": n(admitted), "admitted_ab": n(admitted & k.isin("A", "B")), "false_admissions": n(admitted & k.isin("C", "D")), "false_rejections": n((d == "reject") & (k == "A"))}
    for c in "ABCD":
        aggs |= {f"class_{c.lower()}": n(k == c)} | {f"class_{c.lower()}_{x}": n((d == x) & (k == c)) for x in ("admit", "defer", "reject")}
    out = judged.groupBy(*keys).agg(*(v.alias(name) for name, v in aggs.items()))
    r = lambda a, b: rate(F.col(a), F.col(b), None)
    return out.withColumns({
        "class_a_admit_rate": r("class_a_admit", "class_a"), "class_c_admit_rate": r("class_c_admit", "class_c"), "class_d_reject_rate": r("class_d_reject", "class_d"),
        "admitted_ab_rate": rate(F.col("admitted_ab"), F.col("admitted_ab") + F.col("false_admissions"), None), "false_admission_rate": r("false_admissions", "admitted"),
    })


def failed_goals(goal_columns: list[str]) -> Column:
    """Goals that the rates miss, in fixed order; a null rate counts as 0."""
    missed = []
    for i, (name, goal) in enumerate(GOALS.items()):
        if name in goal_columns:
            value = F.coalesce(F.col(name), F.lit(0.0))
            missed.append(F.when(value < goal if i < 4 else value > goal, name))
    return F.filter(F.array(*missed), lambda x: x.isNotNull())
