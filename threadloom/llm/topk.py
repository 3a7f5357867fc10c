"""Exact top-k by inner product with block-at-a-time pruning.

Vectors are integer term weights. They are put in an order in which neighbours share their largest terms, and cut
into ranges. A range keeps its vectors (a forward index) in blocks, with the largest and the smallest
weight of each term in each block. For a pack of queries the blocks are taken in order of the largest score that they
can hold, the sum over the terms, until that falls below the k-th best score so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, pick

#: Vectors in a block, in a range (about) and queries in a pack.
BLOCK, RANGE, PACK = 256, 8192, 256


def weights(vectors: DataFrame, scale: float) -> DataFrame:
    """(id, w): each component x as floor(scale * x); vectors with a null or non-finite component are left out."""
    x = F.transform("x", lambda v: v.cast("double"))
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.withColumn("x", x).where(F.col("x").isNotNull() & fine & F.col("id").isNotNull()).select("id", F.transform("x", lambda v: F.floor(v * scale)).alias("w"))


def _matrix(rows: list[list[int]]) -> np.ndarray:
    out = np.zeros((len(rows), max(map(len, rows), default=0)), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _narrow(m: np.ndarray) -> np.ndarray:
    """m in the narrowest whole numbers that hold it."""
    low, high = int(m.min(initial=0)), int(m.max(initial=0))
    return m.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def _wide(raw: bytes, n: int, dims: int) -> np.ndarray:
    """The n rows of dims weights that _narrow made."""
    return np.frombuffer(raw, f"i{len(raw) // max(n * dims, 1) or 8}").reshape(n, dims)


def _packed(size: int):
    """Rows (part, id, w) to packs of at most `size` rows: ids and weights as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, size):
                some = batch.slice(i, size)
                m = _matrix(some.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([some.column(0).slice(0, 1), pa.array([m.shape[1]], pa.int32()), pa.array([np.array(some.column(1).to_pylist(), np.int64).tobytes()], pa.binary()), pa.array([_narrow(m).tobytes()], pa.binary())], ["part", "dims", "ids", "w"])

    return run


def _search(q: np.ndarray, q_ids: np.ndarray, v: np.ndarray, v_ids: np.ndarray, k: int, not_self: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """Scores and ids of the k best vectors of each query, best first (ids -1: none), and the number of blocks scored."""
    d = max(q.shape[1], v.shape[1])
    q, v = (np.pad(m, ((0, 0), (0, d - m.shape[1]))) for m in (q, v))
    most_of = lambda m: max(int(m.max(initial=0)), -int(m.min(initial=0)))
    largest = most_of(q) * most_of(v) * max(d, 1)
    # whole numbers stay exact; beyond 64 bits Python's own are used, and a score becomes the largest or smallest that fits
    kind = np.float32 if largest < 1 << 24 else np.float64 if largest < 1 << 53 else np.int64 if largest < 1 << 63 else object
    q, v = q.astype(kind), v.astype(kind)
    blocks = [slice(i, i + BLOCK) for i in range(0, len(v), BLOCK)]
    most, least = (np.stack([f(v[b], 0) for b in blocks]) for f in (np.max, np.min))
    bound = np.maximum(q, 0) @ most.T + np.minimum(q, 0) @ least.T
    order = np.argsort(-bound, 1, kind="stable")
    low = np.iinfo(np.int64).min
    scores, ids = np.full((len(q), k), low, np.int64), np.full((len(q), k), -1, np.int64)
    live, done = np.arange(len(q)), 0
    for turn in range(len(blocks)):
        nxt = order[live, turn]
        go = (bound[live, nxt] >= scores[live, -1]) | (ids[live, -1] < 0)  # an equal score may have a smaller id
        live, nxt = live[go], nxt[go]
        if not len(live):
            break
        for b in np.unique(nxt):
            who = live[nxt == b]
            some, done = v_ids[blocks[b]], done + len(who)
            got = q[who] @ v[blocks[b]].T
            got = (np.clip(got, low + 1, np.iinfo(np.int64).max) if kind is object else got).astype(np.int64)
            if not_self:
                got[q_ids[who][:, None] == some[None]] = low
            all_scores = np.concatenate([scores[who], got], 1)
            all_ids = np.concatenate([ids[who], np.broadcast_to(some, got.shape)], 1)
            all_ids[all_scores == low] = -1
            best = np.lexsort((all_ids, np.invert(all_scores)), 1)[:, :k]
            scores[who], ids[who] = np.take_along_axis(all_scores, best, 1), np.take_along_axis(all_ids, best, 1)
    return scores, ids, done


def exact_topk(vectors: DataFrame, queries: DataFrame, *, k: int = 5, scale: float = 256.0, not_self: bool = True, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k vectors of the highest inner product for each query: query_id, rank (from 1), vec_id, score.

    Ties go to the smaller id. With not_self a query's own row is left out. Fewer rows come where there are fewer
    candidates. Vectors that are null or hold a null or non-finite component, and rows without id, take no part; a
    shorter vector counts as filled up with zeros; an empty one scores 0. Components are cut to 64 bits after scaling, and so are scores. Repeated rows are candidates of their
    own; a query id that repeats counts once. Empty tables give an empty result.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    v = weights(pick(vectors, id=id_col, x=vector_col), scale)
    q = weights(pick(queries, id=id_col, x=vector_col), scale).dropDuplicates(["id"])
    n = vectors.count()
    ranges = max(1, -(-n // RANGE))
    top = lambda f: F.coalesce(F.array_position("w", f("w")), F.lit(0))
    ordered = v.withColumns({"a": top(F.array_max), "b": top(F.array_min)}).repartitionByRange(ranges, "a", "b", "id").sortWithinPartitions("a", "b", "id")
    packed = "part int, dims int, ids binary, w binary"
    index = scratch.keep(ordered.select(F.spark_partition_id().alias("part"), "id", "w").mapInArrow(_packed(RANGE), packed))
    packs = q.repartition(max(1, -(-n // (RANGE * 8))), "id").select(F.spark_partition_id().alias("part"), "id", "w").mapInArrow(_packed(PACK), packed)
    # The stated queries against all rows, in blocks: each pack is sent to each range.
    parts = index.agg(F.coalesce(F.max("part"), F.lit(0)).alias("n")).first().n
    packs = packs.select(F.explode(F.sequence(F.lit(0), F.lit(parts))).alias("part"), F.col("dims").alias("q_dims"), F.col("ids").alias("q_ids"), F.col("w").alias("q_w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in ("dims", "ids", "w", "q_dims", "q_ids", "q_w")}
                q_ids, v_ids = (np.frombuffer(r[c], np.int64) for c in ("q_ids", "ids"))
                q, v = (_wide(r[c], len(x), r[m]) for c, x, m in (("q_w", q_ids, "q_dims"), ("w", v_ids, "dims")))
                scores, ids, _ = _search(q, q_ids, v, v_ids, k, not_self)
                ok = scores.ravel() > np.iinfo(np.int64).min
                yield pa.RecordBatch.from_arrays([pa.array(x.ravel()[ok]) for x in (np.repeat(q_ids, k), ids, scores)], ["query_id", "vec_id", "score"])

    # Always by a shuffle: Spark guesses the packs' size from what it is before they are copied, and would send all copies through the driver.
    # As many partitions as ranges: by their bytes, which say little of the work, Spark would put many ranges into one task.
    cells = packs.repartition(parts + 1, "part").join(index.repartition(parts + 1, "part").hint("merge"), "part").select("dims", "ids", "w", "q_dims", "q_ids", "q_w")
    found = cells.mapInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
