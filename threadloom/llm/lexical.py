"""Ranked lexical search by TPUT (three-phase uniform threshold) over term-partitioned postings.

Only the queries' terms get postings. A list is one term's postings in order of their score; lists are cut by ranges of (term, score), so
a term of any number of documents spreads over tasks. For each query:

1. the heads of its lists give partial sums, of which the k-th best is a lower bound of the k-th score;
2. a k-th score needs a part of at least bound / lists in one list, so each list is read down to that threshold, and what was read meets by
   blocks of documents; the partial sums give a better bound, and a document stays a candidate if its sum and what its other
   lists can still hold reach that;
3. the candidates' exact scores are looked up in the forward index, a row a document.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .common import LOWER, UPPER, Scratch, maybe_broadcast, pick, release_memory

#: Fixed by the contract: a term.
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Documents in a block, and queries that are summed at once.
BLOCK, PACK = 4096, 256
_LOWER = str.maketrans(UPPER, LOWER)


def terms(text: str | None) -> list[str]:
    return TERM.findall((text or "").translate(_LOWER))


def query_terms(queries: DataFrame) -> DataFrame:
    """(item, term, times) of rows (item, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out, times = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for term, n in Counter(terms(text)).items():
                    at.append(i)
                    out.append(term)
                    times.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), pa.array(out, pa.string()), pa.array(times, pa.int64())], ["item", "term", "times"])

    return queries.mapInArrow(run, f"item {queries.schema['item'].dataType.simpleString()}, term string, times long")


def forward_index(docs: DataFrame, words: DataFrame | None) -> DataFrame:
    """One row a document: row (a number of its own), id, n (its terms with repeats), and its terms with their occurrences, only those of
    words (a table small enough for every task) if that is given."""
    held = docs.sparkSession.sparkContext.broadcast(None if words is None else frozenset(r.term for r in words.collect()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = held.value
        for batch in batches:
            n, found, tf, ends = [], [], [], [0]
            for text in batch.column(2).to_pylist():
                all_ = terms(text)
                n.append(len(all_))
                counts = Counter(all_ if wanted is None else filter(wanted.__contains__, all_))
                found += counts
                tf += counts.values()
                ends.append(len(found))
            ends = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, kind)) for x, kind in ((found, pa.string()), (tf, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), *lists], ["row", "id", "n", "terms", "tf"])
        release_memory()

    kind = docs.schema["id"].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "id", "text")
    return rows.mapInArrow(run, f"row long, id {kind}, n long, terms array<string>, tf array<long>")


def weight(n_docs: Column, df: Column) -> Column:
    return F.floor(1000 * F.log((2 * n_docs + 2).cast("double") / (2 * df + 1).cast("double")))


def part(w: Column, tf: Column, n: Column, n_docs: Column, n_terms: Column) -> Column:
    """What one occurrence of a term in a query adds to a document's score; whole numbers, divided downwards."""
    m = 25 + _div(75 * n * n_docs, n_terms)
    return w * _div(1_000_000_000 * tf, 1000 * tf + 8 * m)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def search(docs: DataFrame, queries: DataFrame, *, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text") -> DataFrame:
    """The k best documents of each query with a score above 0, all if there are fewer: item id, rank (from 1), doc id, score. Equal scores
    come by ascending doc id, null ids last.

    Each row is a document of its own, also where ids or texts repeat. Query ids that repeat are one query with all its rows' terms, null ones are no query. Null
    texts have no terms; documents without terms count nowhere, queries without any get no rows, and neither do empty tables. A term that
    nearly all documents have may have weight 0 and adds nothing. Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lexical")
    asked = query_terms(pick(queries, item=item_col, text=query_col)).where("item IS NOT NULL").groupBy("item", "term").agg(F.sum("times").alias("times"))
    asked = scratch.keep(asked)
    n_words, size = (x or 0 for x in asked.select("term").distinct().agg(F.count("*"), F.sum(F.octet_length("term") + 64)).first())
    words = asked.select("term").distinct() if size <= common.BROADCAST_BYTES else None
    forward = scratch.keep(forward_index(pick(docs, id=id_col, text=text_col), words))
    n_docs, n_terms = forward.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()

    flat = forward.select("row", "n", F.explode(F.arrays_zip("terms", "tf")).alias("p")).select("row", "n", F.col("p.terms").alias("term"), F.col("p.tf").alias("tf"))
    if words is None:
        flat = flat.join(asked.select("term").distinct(), "term", "left_semi")
    df = scratch.keep(flat.groupBy("term").agg(F.count("*").alias("df")))
    wide = lambda x: maybe_broadcast(x, n_words, 64)
    # terms get numbers, which are shorter than their texts and keep an order
    terms_ = scratch.keep(df.select("term", weight(F.lit(n_docs), F.col("df")).alias("w"), F.monotonically_increasing_id().alias("t")))
    score = part(F.col("w"), F.col("tf"), F.col("n"), F.lit(n_docs), F.lit(max(n_terms, 1)))
    postings = flat.join(wide(terms_), "term").select("t", "row", score.alias("part"))
    lists = scratch.keep(postings.repartitionByRange("t", F.desc("part"), "row").sortWithinPartitions("t", F.desc("part"), "row"))

    # a term that adds 0 is in no list
    asked = scratch.keep(asked.join(wide(terms_), "term").where("w > 0").select("item", "t", "times", "term"))
    n_asked, n_items = asked.agg(F.count("*"), F.count_distinct("item")).first()
    small = lambda x: maybe_broadcast(x, n_asked, 64)
    few = lambda x: maybe_broadcast(x, n_items, 64)

    # 1. heads; the limit of each window is applied in the tasks before rows are exchanged
    nth = F.row_number().over(Window.partitionBy("t").orderBy(F.desc("part"), "row"))
    heads = scratch.keep(lists.withColumn("nth", nth).where(F.col("nth") <= k))
    own = F.col("part") * F.col("times")
    sums = heads.join(small(asked), "t").groupBy("item", "row").agg(F.sum(own).alias("sum"))
    first = asked.groupBy("item").agg(F.count("*").alias("lists")).join(_kth(sums, k), "item", "left")

    # 2. every list down to the uniform threshold; fewer than k sums so far: any score above 0 counts
    bound = F.coalesce("kth", F.lit(1).cast("long"))
    least = first.select("item", bound.alias("bound"), _div(bound + F.col("lists") - 1, F.col("lists")).alias("least"))
    most = heads.where("nth = 1").select("t", F.col("part").alias("most"))
    reach = asked.drop("term").join(few(least), "item").join(most, "t")
    reach = scratch.keep(reach.withColumn("hold", F.least(F.col("least") - 1, F.col("times") * F.col("most"))))
    cut = reach.groupBy("t").agg(F.min(_div(F.col("least") + F.col("times") - 1, F.col("times"))).alias("cut"))
    near = lists.join(small(cut), "t").where(F.col("part") >= F.col("cut")).drop("cut")
    reach = reach.select("t", "item", "times", "least", "hold", "bound")
    start = reach.groupBy("item").agg(F.first("bound").alias("bound"))
    better = lambda sums: start.join(_kth(sums, k), "item", "left").select("item", F.greatest("bound", "kth").alias("bound"))
    if n_asked * 64 <= common.BROADCAST_BYTES:
        blocks = _Blocks(scratch.keep(_blocks(near)), reach)
        level = better(blocks.best(k))
        candidates = scratch.keep(blocks.above(level))
    else:
        sums = scratch.keep(_sums(near, reach))
        candidates = scratch.keep(sums.join(few(better(sums)), "item").where(F.col("most") >= F.col("bound")).select("item", "row"))

    # 3. exact scores from the forward index
    found = forward.join(maybe_broadcast(candidates, candidates.count(), 32), "row").select("item", "row", "id", "n", F.explode(F.arrays_zip("terms", "tf")).alias("p"))
    found = found.select("item", "row", "id", "n", F.col("p.terms").alias("term"), F.col("p.tf").alias("tf"))
    found = found.join(wide(terms_), "term").join(small(asked.drop("t")), ["item", "term"])
    exact = found.groupBy("item", "row").agg(F.first("id").alias("id"), F.sum(score * F.col("times")).alias("score"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row"))
    best = exact.where("score > 0").withColumn("rank", rank).where(F.col("rank") <= k)
    return best.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def _sums(near: DataFrame, reach: DataFrame) -> DataFrame:
    """(item, row, sum, most): each document's sum of what was read of an item's lists, and with what its other lists can hold."""
    own = F.col("part") * F.col("times")
    seen = near.join(reach.drop("bound"), "t").where(own >= F.col("least")).groupBy("item", "row").agg(F.sum(own).alias("sum"), F.sum(own - F.col("hold")).alias("over"))
    rest = reach.groupBy("item").agg(F.sum("hold").alias("hold"))
    return seen.join(rest, "item").select("item", "row", "sum", (F.col("over") + F.col("hold")).alias("most"))


def _blocks(near: DataFrame) -> DataFrame:
    """What was read of all lists, packed by blocks of documents: terms, documents and parts, in the order of the terms."""

    def run(table: pa.Table) -> pa.Table:
        t = table.column("t").to_numpy()
        order = np.argsort(t, kind="stable")
        cols = [t[order], table.column("row").to_numpy()[order], table.column("part").to_numpy()[order]]
        return pa.table([pa.array([c.astype(np.int64).tobytes()], pa.binary()) for c in cols], ["t", "row", "part"])

    return near.withColumn("block", F.floor(F.col("row") / BLOCK)).groupBy("block").applyInArrow(run, "t binary, row binary, part binary")


class _Blocks:
    """Partial sums of queries that fit every task, by blocks of documents."""

    def __init__(self, blocks: DataFrame, reach: DataFrame):
        self.blocks, self.spark = blocks, blocks.sparkSession
        given = reach.collect()
        items = list(dict.fromkeys(r["item"] for r in given))
        self.number = {x: i for i, x in enumerate(items)}
        self.hold = np.zeros(len(items), np.int64)
        of: dict[int, list[tuple[int, int, int, int]]] = {}
        for r in given:
            i = self.number[r["item"]]
            self.hold[i] += r["hold"]
            of.setdefault(r["t"], []).append((i, r["times"], r["least"], r["hold"]))
        self.of = of
        names = self.spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"no long, item {reach.schema['item'].dataType.simpleString()}")
        self.named = lambda rows: rows.join(F.broadcast(names), "no").drop("no")

    def _run(self, choose, schema: str, names: list[str]) -> DataFrame:
        held = self.spark.sparkContext.broadcast((self.of, self.hold))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of, hold = held.value
            for batch in batches:
                for b in range(batch.num_rows):
                    t, row, part = (np.frombuffer(batch.column(c)[b].as_py(), np.int64) for c in ("t", "row", "part"))
                    rows, at = np.unique(row, return_inverse=True)
                    terms_, starts = np.unique(t, return_index=True)
                    lists = list(zip(terms_.tolist(), starts.tolist(), [*starts[1:].tolist(), len(t)], strict=True))
                    for first in range(0, len(hold), PACK):
                        n = min(PACK, len(hold) - first)
                        sums, over = np.zeros((n, len(rows)), np.int64), np.zeros((n, len(rows)), np.int64)
                        for term, x, y in lists:
                            for i, times, least, most in of.get(term, ()):
                                if first <= i < first + n:
                                    own = part[x:y] * times
                                    read = own >= least
                                    sums[i - first, at[x:y][read]] += own[read]
                                    over[i - first, at[x:y][read]] += own[read] - most
                        over += hold[first : first + n, None]
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in choose(first, rows, sums, over)], names)
            release_memory()

        return self.named(self.blocks.mapInArrow(run, schema))

    def best(self, k: int) -> DataFrame:
        """(item, row, sum): the k largest sums of each block."""

        def choose(first, rows, sums, over):
            m = min(k, len(rows))
            j = np.argpartition(sums, len(rows) - m, 1)[:, len(rows) - m :]
            i = np.repeat(np.arange(len(sums)), m)
            got = sums[i, j.ravel()]
            return (i + first)[got > 0], rows[j.ravel()][got > 0], got[got > 0]

        return self._run(choose, "no long, row long, sum long", ["no", "row", "sum"])

    def above(self, level: DataFrame) -> DataFrame:
        """(item, row): the documents that can reach their item's bound."""
        bound = np.zeros(len(self.hold), np.int64)
        for r in level.collect():
            bound[self.number[r["item"]]] = r["bound"]
        held = self.spark.sparkContext.broadcast(bound)

        def choose(first, rows, sums, over):
            i, j = np.nonzero((sums > 0) & (over >= held.value[first : first + len(sums), None]))
            return i + first, rows[j]

        return self._run(choose, "no long, row long", ["no", "row"])


def _kth(sums: DataFrame, k: int) -> DataFrame:
    """(item, kth): the k-th largest sum of each item that has as many."""
    nth = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("sum"), "row"))
    return sums.withColumn("nth", nth).where(F.col("nth") <= k).where(F.col("nth") == k).select("item", F.col("sum").alias("kth"))
