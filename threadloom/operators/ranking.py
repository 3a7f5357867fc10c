"""Choices by order: latest, top n, representatives, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import spotlight_rank, spotlight_score, thought_date
from ..functions.text import fnv1a
from ..shared import kept

#: Bits of a row's number within its partition in monotonically_increasing_id, a fixed value of Spark.
_ROW_BITS = 33


def top_n(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def latest(rows: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    return top_n(rows, keys, [F.desc(at), F.desc(tie)], 1).drop("rank")


def first_occurrence(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return top_n(rows, keys, [F.asc(c) for c in order], 1).drop("rank")


def spotlight(observations: DataFrame, now: Column, n: int = 1) -> DataFrame:
    """The n best observations to show. Connections and tensions need two sessions."""
    score = spotlight_score(F.col("kind"), F.col("first_seen_at"), F.col("last_seen_at"), F.col("distinct_session_count"), F.col("support_type"), now)
    fit = observations.where(~F.col("kind").isin("connection", "tension") | (F.col("distinct_session_count") >= 2))
    key = F.coalesce(thought_date(F.col("last_seen_at"), F.col("first_seen_at")), F.col("detected_at"))
    return fit.withColumn("score", score).orderBy(F.desc("score"), F.desc(key), spotlight_rank(F.col("kind")), "id").limit(n)


def representatives(rows: DataFrame, keys: list[str], session: str, order: list[str], n: int = 2) -> DataFrame:
    """Up to n rows of each key: the first of each session in order, then others in order. Adds `rank`."""
    first = F.row_number().over(Window.partitionBy(*keys, session).orderBy(*order))
    return top_n(rows.withColumn("_again", (first > 1).cast("int")), keys, [F.col("_again"), *(F.col(c) for c in order)], n).drop("_again")


def first_distinct(rows: DataFrame, keys: list[str], value: str, order: list[str], n: int = 3) -> DataFrame:
    """Adds `slot` (from 1) to the first row of each value among the first n values of a key; others have null and `reason`
    duplicate or over_limit. A repeat takes no slot."""
    again = F.row_number().over(Window.partitionBy(*keys, value).orderBy(*order))
    rows = rows.withColumn("_new", (again == 1).cast("int"))
    slot = F.sum("_new").over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_slot", slot)
    reason = F.when(F.col("_new") == 0, "duplicate").when(F.col("_slot") > n, "over_limit")
    return rows.withColumns({"reason": reason, "slot": F.when(reason.isNull(), F.col("_slot"))}).drop("_new", "_slot")


def numbered(rows: DataFrame, order: list[Column], keys: list[str] = (), name: str = "place") -> DataFrame:
    """Adds each row's number, from 1, in an order over the whole table, or over the rows of each key, without a window that holds them.

    Rows are dealt by ranges of keys and order and sorted within; the first number of a range is the sum of the rows of those before
    it, of which the driver gets one count a range. A key of any number of rows spreads over ranges. Of rows that are equal in the
    order any comes first, but all in one range, so the order should end with a unique column.
    """
    by = [*(F.col(k).asc_nulls_first() for k in keys), *order]
    at = F.monotonically_increasing_id()
    ranges = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", at)
    ranges = kept(ranges.withColumn("_range", F.shiftright("_at", _ROW_BITS).cast("int")), "numbered")
    number = F.col("_at").bitwiseAND((1 << _ROW_BITS) - 1) + 1
    before, offsets = 0, []
    for r in ranges.groupBy("_range").count().orderBy("_range").collect():
        offsets.append((r["_range"], before))
        before += r["count"]
    starts = rows.sparkSession.createDataFrame(offsets, "_range int, _before long")
    out = ranges.join(F.broadcast(starts), "_range").withColumn(name, number + F.col("_before")).drop("_range", "_before", "_at")
    if not keys:
        return out
    first = out.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg((F.min(name) - 1).alias("_first"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return out.join(first, same).withColumn(name, F.col(name) - F.col("_first")).drop("_first", *(f"_{k}" for k in keys))


def batch_count(n: Column, target: int = 6) -> Column:
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / target + 0.5)))


def balanced_batches(rows: DataFrame, keys: list[str], ref: str, seed: str, target: int = 6) -> DataFrame:
    """Deals each key's rows into batches of about `target`, sizes differing by at most 1, in order of a hash of seed:ref.
    Adds batch_no and place, both from 1."""
    rows = rows.withColumn("hash", fnv1a(F.concat(F.lit(f"{seed}:"), F.col(ref))))
    w = Window.partitionBy(*keys)
    rows = rows.withColumns({"place": F.row_number().over(w.orderBy("hash", ref)), "_n": F.count("*").over(w)})
    k = batch_count(F.col("_n"), target)
    small, more = F.floor(F.col("_n") / k), F.col("_n") % k  # the first `more` batches have one row more
    long_part = more * (small + 1)
    at = F.col("place") - 1
    batch = F.when(at < long_part, F.floor(at / (small + 1))).otherwise(more + F.floor((at - long_part) / small)) + 1
    return rows.withColumn("batch_no", batch.cast("int")).drop("_n")


def batches_over_all(rows: DataFrame, ref: str, seed: str, target: int = 6) -> DataFrame:
    """As balanced_batches over the whole table, of any size: places come from ranges of the hash, so no task holds all rows."""
    placed = numbered(rows.withColumn("hash", fnv1a(F.concat(F.lit(f"{seed}:"), F.col(ref)))), [F.asc("hash"), F.asc(ref)])
    n = placed.count()
    k = max(1, int(n / target + 0.5))
    small, more = divmod(n, k)
    long_part = more * (small + 1)
    at = F.col("place") - 1
    batch = F.when(at < long_part, F.floor(at / (small + 1))).otherwise(more + F.floor((at - long_part) / max(small, 1))) + 1
    return placed.withColumn("batch_no", batch.cast("int"))
