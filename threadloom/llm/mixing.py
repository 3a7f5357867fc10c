"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame functions only.

A mix takes blocks of equally many words. Sources get blocks by the highest quotients of their target, v / 1, v / 3, v / 5, ..., and
a source's blocks go to its shards in the same way, so each shard has a whole number of blocks as its quota. Within a shard the documents
stand in a seeded order and are cut into its blocks; a quota takes all blocks equally often and the rest of it once more, from a seeded
block on. As the order is seeded, a run of blocks is a sample of the shard; as it is a run, most documents are taken whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import numbered
from .common import Scratch, maybe_broadcast, pick

#: Fixed by the contract: what a word is, the weights of the sources in order, and how often a document may be taken.
WORD, WEIGHTS, MOST = r"[^\x20\x09-\x0D]+", (5, 2, 1), 3
#: Words in a block, and documents in a shard (about).
BLOCK, SHARD = 16, 8192


def draw(seed: str, value: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(value.cast("string"), F.lit(""))))


def _number(hexed: Column) -> Column:
    return F.conv(F.substring(hexed, 1, 8), 16, 10).cast("long")


def apportion(parties: DataFrame, group: str, key: str, votes: str, seats: str, scratch: Scratch) -> DataFrame:
    """Adds `quota`: each party's number of the group's highest quotients votes / (2 n + 1), ties to the smaller key. `seats` has the
    number of a group's seats in each of its rows. Votes below 0 or null count as 0; a group without votes gives no seats.

    Only quotients that can decide are ranked. A party of v votes has floor(v x + 1/2) quotients of at least 1 / (2 x). With x =
    (seats - parties / 2) / all votes these are no more than the seats, so all are given; with (seats + parties / 2) they are
    enough. Between them lie about as many quotients as parties, whatever the seats.
    """
    v = F.greatest(F.coalesce(F.col(votes).cast("double"), F.lit(0.0)), F.lit(0.0))
    all_ = parties.groupBy(F.col(group).alias("_g")).agg(F.sum(v).alias("_votes"), F.count("*").alias("_n"))
    with_all = parties.join(all_, F.col(group) == F.col("_g")).drop("_g")
    given = lambda seats_: F.floor(v * seats_ / F.col("_votes") + 0.5)
    live = (v > 0) & (F.col(seats) > 0)
    # one less and one more than that, as x is rounded
    low = F.when(live, F.greatest(F.lit(0).cast("long"), given(F.col(seats) - F.col("_n") / 2) - 1)).otherwise(0)
    high = F.when(live, F.greatest(F.lit(0).cast("long"), given(F.col(seats) + F.col("_n") / 2) + 1)).otherwise(0)
    sure = scratch.keep(with_all.withColumns({"_low": low, "_high": high}))
    open_ = F.when(F.col("_high") > F.col("_low"), F.sequence("_low", F.col("_high") - 1))
    candidates = sure.select(F.col(group).alias("_g"), F.col(key).alias("_k"), v.alias("_v"), F.explode(open_).alias("_s"))
    ranked = numbered(candidates.withColumn("_q", F.col("_v") / (2 * F.col("_s") + 1)), [F.desc("_q"), F.asc("_k"), F.asc("_s")], ["_g"], "_rank")
    left = sure.groupBy(F.col(group).alias("_h")).agg((F.max(seats) - F.sum("_low")).alias("_left"))
    more = ranked.join(left, F.col("_g") == F.col("_h")).where("_rank <= _left").groupBy("_g", "_k").agg(F.count("*").alias("_more"))
    out = sure.join(more, (F.col(group) == F.col("_g")) & (F.col(key) == F.col("_k")), "left")
    return out.withColumn("quota", F.col("_low") + F.coalesce("_more", F.lit(0))).drop("_g", "_k", "_more", "_low", "_high", "_votes", "_n")


def targets(sources: DataFrame, size: str, weight: str, most: int = MOST) -> DataFrame:
    """Adds `target`: the sum of all sizes shared by weight, but at most `most` times a source's size, the excess shared by weight among
    the others until none is above. Each round only moves two sums to the driver; once above, a source stays above, so rounds end."""
    s, w = F.col(size), F.col(weight)
    total, weights = sources.agg(F.coalesce(F.sum(s), F.lit(0)), F.coalesce(F.sum(w), F.lit(0))).first()
    # x weight > most size, in whole numbers of any length
    wide = lambda c: c.cast("decimal(19,0)")
    free, open_weights, full = total, weights, 0
    while open_weights:
        above = wide(F.lit(free)) * wide(w) > wide(most * s) * wide(F.lit(open_weights))
        n, capped, gone = sources.agg(F.coalesce(F.sum(above.cast("long")), F.lit(0)), F.coalesce(F.sum(F.when(above, s)), F.lit(0)), F.coalesce(F.sum(F.when(above, w)), F.lit(0))).first()
        if n == full:
            break
        full, free, open_weights = n, total - most * capped, weights - gone
    if not open_weights:
        return sources.withColumn("target", (most * s).cast("double"))
    above = wide(F.lit(free)) * wide(w) > wide(most * s) * wide(F.lit(open_weights))
    return sources.withColumn("target", F.when(above, (most * s).cast("double")).otherwise(F.lit(float(free)) / F.lit(float(open_weights)) * w))


def mix(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK, shard: int = SHARD, seed: str = "mix") -> DataFrame:
    """One row per input row: id, source, size (words), source_size, target, taken (words, repeats counted), copies (how often the
    whole document is taken) and extra (ranges [first, end) of its words that are taken once more).

    Sources are in code point order, null last and a source of its own, and weigh `weights` in turn. No document is taken more than `most`
    times. Null and empty texts have size 0 and are never taken; null ids are drawn as the empty text. Rows that repeat are documents of their own; where all columns
    are equal they may change places. The same rows give the same mix in any order and any partitions. An empty table
    gives an empty result. A source whose target is below half a block may be taken not at all. Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    rows = pick(docs, id=id_col, source=source_col, text=text_col)
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = scratch.keep(rows.select("id", F.col("source").cast("string").alias("source"), words.alias("size"), draw(seed, F.col("id")).alias("draw")))

    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sources = numbered(sources, [F.col("source").isNull().asc(), F.asc("source")], name="no")
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("no") - 1, F.lit(len(weights))).cast("int") + 1).cast("long")
    sources = sources.withColumns({"weight": weight, "shards": F.ceil(F.col("n") / shard)})
    sources = scratch.keep(targets(sources, "source_size", "weight", most))
    n, total = sources.agg(F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    seats = (total + block // 2) // block
    given = apportion(sources.select("no", "target", F.lit(0).alias("all"), F.lit(seats).alias("seats")), "all", "no", "target", "seats", scratch)
    quotas = given.select("no", F.col("quota").alias("seats"))

    of = sources.select(F.col("source").alias("_source"), "no", "source_size", "target", "shards")
    dealt = rows.join(maybe_broadcast(of, n, 96), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    dealt = dealt.withColumn("shard", F.pmod(_number(F.col("draw")), F.col("shards")))
    cells = scratch.keep(dealt.groupBy("no", "shard").agg(F.sum("size").alias("words")))
    held = cells.join(quotas, "no")
    blocks = F.ceil(F.col("words") / block)
    quota = apportion(held, "no", "shard", "words", "seats", scratch).withColumn("blocks", blocks)
    quota = quota.withColumn("quota", F.least("quota", most * F.col("blocks")))
    first = F.pmod(_number(draw(seed, F.concat_ws("/", "no", "shard"))), F.col("blocks"))
    rest = F.pmod(F.col("quota"), F.col("blocks"))
    edge = lambda k: k * F.floor(F.col("words") / F.col("blocks")) + F.least(k, F.pmod(F.col("words"), F.col("blocks")))  # noqa: E731  words before block k
    cut = quota.where("blocks > 0").select("no", "shard", F.floor(F.col("quota") / F.col("blocks")).alias("copies"), edge(first).alias("a1"), edge(F.least(first + rest, "blocks")).alias("b1"), edge(F.greatest(first + rest - F.col("blocks"), F.lit(0))).alias("b2"))

    start = F.sum("size").over(Window.partitionBy("no", "shard").orderBy("draw", "id", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = dealt.withColumn("start", start).join(cut, ["no", "shard"], "left")
    inside = lambda a, b: F.struct(F.greatest(F.lit(0).cast("long"), a - F.col("start")).alias("first"), F.least("size", b - F.col("start")).alias("end"))
    extra = F.filter(F.array(inside(F.lit(0), F.col("b2")), inside(F.col("a1"), F.col("b1"))), lambda x: x["first"] < x["end"])
    placed = placed.withColumns({"copies": F.coalesce("copies", F.lit(0)), "extra": F.coalesce(extra, F.array())})
    taken = F.col("copies") * F.col("size") + F.aggregate("extra", F.lit(0).cast("long"), lambda n_, x: n_ + x["end"] - x["first"])
    return placed.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", taken.alias("taken"), "copies", "extra")
