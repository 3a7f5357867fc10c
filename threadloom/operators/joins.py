"""Joins that recur: lookups with reasons, links of keys, rows that are or aren't there."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import kept


def in_request_order(rows: DataFrame, id_: str, ids: list) -> DataFrame:
    """The rows of the ids, in the order asked for; repeats and unknown ids are left out."""
    want = rows.sparkSession.createDataFrame([(x, i) for i, x in enumerate(dict.fromkeys(ids))], f"{id_} {rows.schema[id_].dataType.simpleString()}, _at int")
    return rows.join(F.broadcast(want), id_).orderBy("_at").drop("_at")


def missing(requested: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    return requested.join(existing.select(*keys), keys, "left_anti")


def present(requested: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    return requested.join(existing.select(*keys), keys, "left_semi")


def resolve_refs(refs: DataFrame, candidates: DataFrame, keys: list[str], ref: str = "ref", order: str = "pos") -> DataFrame:
    """Looks refs up, first use only. Adds the candidates' columns, and valid: false where there is no such candidate."""
    first = F.row_number().over(Window.partitionBy(*keys, ref).orderBy(order))
    once = refs.withColumn(ref, F.trim(ref)).withColumn("_n", first).where("_n = 1").drop("_n")
    return once.join(candidates.withColumn("_hit", F.lit(True)), [*keys, ref], "left").withColumn("valid", F.coalesce("_hit", F.lit(False))).drop("_hit")


#: Characters of the pieces by which keys are looked up, at most.
PIECE = 4
#: Keys with the same piece that meet in one task, at most; and the largest estimated size of a table that is sent to all, in bytes.
TOGETHER, BROADCAST_BYTES = 4096, 16 << 20


def key_containment(keys: DataFrame, id_: str, key: str, within: list[str] = ()) -> DataFrame:
    """Pairs (inner, outer) of different ids where the outer key has the inner one, of two characters or more, in it; only pairs that agree in
    the columns of `within`.

    A piece of more than TOGETHER keys is dealt into parts, with the inner keys copied to each.

    Each key is looked up by its rarest piece of PIECE characters (or by itself, if it is shorter) among the pieces of that length of all
    others, so only keys that share it meet, where a plain join would compare all with all.
    """
    rows = keys.select(*within, F.col(id_).alias("id"), F.col(key).alias("k")).where(F.length("k") >= 2)
    pieces = lambda n: F.when(F.length("k") >= n, F.transform(F.sequence(F.lit(1), F.length("k") - (n - 1)), lambda i: F.substring("k", i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    grams = rows.select(*within, "id", "k", F.explode(F.array_distinct(F.concat(*map(pieces, range(2, PIECE + 1))))).alias("gram"))
    on = [*within, "gram"]
    count = grams.groupBy(*on).agg(F.count("*").alias("n"))
    own = grams.where(F.length("gram") == F.least(F.length("k"), F.lit(PIECE)))
    rare = own.join(count, on).groupBy(*within, "id", "k").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    inner = rare.select(*within, F.col("id").alias("inner_id"), F.col("k").alias("inner_key"), "gram")
    outer = grams.select(*within, F.col("id").alias("outer_id"), F.col("k").alias("outer_key"), "gram")
    hot = kept(count.where(F.col("n") > TOGETHER).select(*on, F.ceil(F.col("n") / TOGETHER).cast("int").alias("parts")), "hot")
    n = hot.count()
    if n:
        hot = F.broadcast(hot) if n * 128 <= BROADCAST_BYTES else hot
        inner = inner.join(hot, on, "left").select("*", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part")).drop("parts")
        outer = outer.join(hot, on, "left").withColumn("part", F.pmod(F.xxhash64("outer_id"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
        on = [*on, "part"]
    return inner.join(outer, on).where((F.col("inner_id") != F.col("outer_id")) & F.col("outer_key").contains(F.col("inner_key"))).drop("gram", "part")
