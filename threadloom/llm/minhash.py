"""Near duplicates by weighted Jaccard similarity of word shingles, with BagMinHash signatures.

A document is a bag of its shingles. Each shingle owns Poisson processes of points, one for each step of a ladder of
weights (0-1, 1-2, 2-4, 4-8, ...), whose points depend on the shingle and the step alone. A document takes the points of
a shingle below its count there: whole steps, and of the last one those whose height is below the count. Each point
falls into one of the registers, which keeps the smallest. A register of two documents holds the same point with a
probability of exactly their weighted Jaccard similarity. Points are made in ascending order and only while
they can still be smaller than the largest register, so most shingles make one point or two.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, maybe_broadcast, pick, release_memory
from .graph import components
from .hashing import Ranges, U, mix

#: Words of a shingle; bands of a signature and registers of a band.
SHINGLE, BANDS, ROWS = 5, 32, 4
#: Bytes of text handled at once.
CHUNK = 1 << 20
#: Texts in a block of a bucket and bytes of their bags, about; columns of a matrix of elements.
BLOCK, BLOCK_BYTES, COLUMNS = 256, 2 << 20, 2048


NONE, TIME = U(0xFFFFFFFFFFFFFFFF), U(0xFFFFFFFFFF000000)


def normal(text: str | None) -> bytes:
    """Lower case, with one space between words."""
    return " ".join((text or "").lower().split()).encode("utf-8", "surrogatepass")


def bags(texts: list[bytes], shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normal texts to (text, shingle, count), in order of text and shingle. A text of fewer words is one shingle."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ends = np.flatnonzero(data == 32)
    starts = np.concatenate([[0], ends[:-1] + 1])
    doc = np.searchsorted(np.cumsum(sizes), starts, "right")
    real = ends > starts  # an empty text has one empty word
    ends, starts, doc = ends[real], starts[real], doc[real]
    if not len(doc):
        return np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64)
    word = Ranges(data).hash(starts, ends)
    n = np.bincount(doc, minlength=len(texts))
    place = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    sh, have = word.copy(), np.minimum(n[doc], shingle)
    for k in range(1, shingle):
        ok = have > k
        at = np.flatnonzero(ok & (place + k < n[doc]))
        sh[at] = mix(sh[at] * U(0x9E3779B97F4A7C15) + word[at + k])
    first = place <= np.maximum(n[doc] - shingle, 0)
    doc, sh = doc[first], sh[first]
    order = np.lexsort((sh, doc))
    doc, sh = doc[order], sh[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (sh[1:] != sh[:-1])
    at = np.flatnonzero(new)
    return doc[at], sh[at], np.diff(np.append(at, len(doc)))


def signatures(n: int, doc: np.ndarray, sh: np.ndarray, count: np.ndarray, registers: int) -> np.ndarray:
    """The smallest point of each register, n rows; all ones where a document has no shingle."""
    steps = np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64) + 1
    which = np.repeat(np.arange(len(doc)), steps)
    step = np.arange(len(which)) - np.repeat(np.cumsum(steps) - steps, steps)
    low = np.where(step == 0, 0, 1 << np.maximum(step - 1, 0))
    rate = np.maximum(low, 1).astype(float)
    part = np.minimum((count[which] - low) / rate, 1.0)  # share of the step's height that counts
    owner = doc[which]
    seed = mix(sh[which] + step.astype(U) * U(0xD1B54A32D192ED03))
    total = np.bincount(doc, count, n)
    cap = registers * (np.log(registers) + 2) / np.maximum(total, 1)
    flat = np.full(n * registers, NONE)
    out = flat.reshape(n, registers)
    time, turn = np.zeros(len(owner)), np.zeros(len(owner), U)
    live, rest = np.arange(len(owner)), [np.zeros(0, np.int64)]
    while len(live):
        turn[live] += U(1)
        r = mix(seed[live] + turn[live] * U(0x9E3779B97F4A7C15))
        time[live] -= np.log(((r >> U(11)).astype(float) + 0.5) * 2.0**-53) / rate[live]
        q = mix(r)
        mine = owner[live]
        hit = (q >> U(40)).astype(float) * 2.0**-24 < part[live]
        register = (q & U(0xFFFF)).astype(np.int64) % registers
        point = time[live].view(U) & TIME | mix(q) >> U(40)  # positive numbers order as their bits do
        np.minimum.at(flat, (mine * registers + register)[hit], point[hit])
        docs = np.flatnonzero(np.bincount(mine, minlength=n))
        top, worst = out[docs].max(1), cap.copy()
        worst[docs] = np.minimum(cap[docs], np.where(top == NONE, np.inf, (top & TIME).view(float)))
        go = time[live] <= worst[mine]
        rest.append(live[~go])
        live = live[go]
        if not len(live):  # documents with an empty register go on beyond their cap
            open_ = (out == NONE).any(1) & (total > 0)
            if open_.any():
                waiting = np.concatenate(rest)
                live, rest = waiting[open_[owner[waiting]]], []
                cap = np.where(open_, cap * 2, cap)
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    key = np.full((len(sig), bands), U(0))
    for r in range(rows):
        key = mix(key * U(0x9E3779B97F4A7C15) + sig[:, r :: rows][:, :bands])
    return mix(key + np.arange(bands, dtype=U)).astype(np.int64)


def _chunks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[bytes]]]:
    """Normal texts, some at a time, with the number of the first."""
    col, some, first, size = batch.column(column), [], 0, 0
    for i in range(0, len(col), 64):
        for j, t in enumerate(col.slice(i, 64).to_pylist()):
            some.append(normal(t))
            size += len(some[-1])
            if size >= CHUNK:
                yield first, some
                some, first, size = [], i + j + 1, 0
    if some:
        yield first, some


def _digest(text: bytes) -> bytes:
    return hashlib.blake2b(text, digest_size=16).digest()


def _sign(shingle: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, some in _chunks(batch, 1):
                doc, sh, count = bags(some, shingle)
                sig = signatures(len(some), doc, sh, count, bands * rows)
                keys = band_keys(sig, bands, rows)
                sizes = np.bincount(doc, count, len(some)).astype(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * bands, pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(some)), pa.array(list(map(_digest, some)), pa.binary()), pa.array(sizes), lists], ["id", "digest", "size", "keys"])
            release_memory()

    return run


def _elements(shingle: int):
    """Rows (node, digest, text) to each text with that digest as a sorted array of numbers, one for each shingle and copy of it, so that
    bags compare as sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, some in _chunks(batch, 2):
                mine = [i for i, (d, t) in enumerate(zip(batch.column(1).slice(first, len(some)).to_pylist(), some, strict=True)) if d == _digest(t)]
                doc, sh, count = bags([some[i] for i in mine], shingle) if mine else bags([b""], shingle)
                copy = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                each, owner = mix(np.repeat(sh, count) + copy.astype(U) * U(0xD1B54A32D192ED03)), np.repeat(doc, count)
                order = np.lexsort((each, owner))
                each = each[order]
                ends = np.cumsum(np.bincount(doc, count, len(mine))).astype(np.int64)
                blobs = [each[a:b].tobytes() for a, b in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True)] if mine else []
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(some)).take(pa.array(mine, pa.int64())), pa.array(blobs, pa.binary())], ["node", "bag"])
            release_memory()

    return run


def _overlap(least: float):
    """Rows (a, b, x, y) of two nodes and their bags to (a, b) of those that are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                if not len(x) or not len(y) or min(len(x), len(y)) < least * max(len(x), len(y)):
                    continue
                at = np.searchsorted(y, x)
                same = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                if same / (len(x) + len(y) - same) >= least:
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], ["a", "b"])

    return run


def similarities(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """The similarity of each bag of x to each of y. Sizes of overlaps are products of 0/1 matrices whose columns are the elements that
    both sides have, some columns at a time."""
    n, m = (np.array([len(b) for b in s], np.int64) for s in (x, y))
    (a, row_a), (b, row_b) = ((np.concatenate(s) if s else np.zeros(0, U), np.repeat(np.arange(len(s)), k)) for s, k in ((x, n), (y, m)))
    shared = np.intersect1d(a, b)
    same = np.zeros((len(x), len(y)), np.float32)
    if len(shared):
        sides = []
        for e, row in ((a, row_a), (b, row_b)):
            at = np.minimum(np.searchsorted(shared, e), len(shared) - 1)
            hit = shared[at] == e
            order = np.argsort(at[hit], kind="stable")
            sides.append((at[hit][order], row[hit][order]))
        for c in range(0, len(shared), COLUMNS):
            part = []
            for (at, row), size in zip(sides, (len(x), len(y)), strict=True):
                i, j = np.searchsorted(at, (c, c + COLUMNS))
                ones = np.zeros((size, min(COLUMNS, len(shared) - c)), np.float32)
                ones[row[i:j], at[i:j] - c] = 1
                part.append(ones)
            same += part[0] @ part[1].T
    return same / np.maximum(n[:, None] + m[None] - same, 1)


def joining(x: list[np.ndarray], y: list[np.ndarray], of_x: np.ndarray, of_y: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Of the links between x and y as many as join their components, most alike first: fewer than there are components."""
    like = similarities(x, y)
    i, j = np.nonzero((like >= least) & (of_x[:, None] != of_y[None]))
    order = np.argsort(-like[i, j], kind="stable")
    root = {c: c for c in (*of_x.tolist(), *of_y.tolist())}

    def find(c):
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    out = []
    for a, b in zip(i[order].tolist(), j[order].tolist(), strict=True):
        p, q = find(int(of_x[a])), find(int(of_y[b]))
        if p != q:
            root[p] = q
            out.append((a, b))
    return out


def _stars(cand: DataFrame, scratch: Scratch) -> DataFrame:
    """A candidate pair of each text of a bucket with the one text of it that is in most company in all its buckets: it is in the middle
    of its group, and the same for most of the group's buckets."""
    company = cand.groupBy("node").agg(F.sum("n").alias("company"))
    centres = cand.join(company, "node").groupBy("key").agg(F.min_by("node", F.struct(-F.col("company"), F.xxhash64("node"), "node")).alias("c"))
    centres = scratch.keep(centres)
    centres = maybe_broadcast(centres, centres.count(), 16)
    return cand.join(centres, "key").where("node <> c").select(F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b")).distinct()


def _open(cand: DataFrame, parts: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, node, component, bytes) of the buckets whose texts are not of one component; of buckets of the same texts one. In buckets
    of two the one pair is tried already."""
    known = cand.where("n > 2").join(parts, "node", "left").select("key", "node", "size", F.coalesce("component", "node").alias("component"))
    known = scratch.keep(known)
    open_ = known.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")).where("low <> high")
    open_ = scratch.keep(open_.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key"))
    return scratch.keep(known.join(maybe_broadcast(open_, open_.count(), 8), "key", "left_semi").select("key", "node", "component", (F.col("size") * 8).alias("bytes")))


def _joined(members: DataFrame, bags_: DataFrame, least: float, scratch: Scratch) -> DataFrame:
    """Links (a, b) that join components of the open buckets: between any two components of a bucket that a link joins.

    Each text is in one block, whatever its buckets: those of a large component have blocks of their own, and small components are put
    with others that share a bucket with the same largest component. Two blocks meet once, with all their bags, if they share a bucket and aren't
    both of one component; there all their texts are compared at once, and only links that join components come out. So a
    group of n texts, of which all but r are joined already, takes r * n comparisons and r * n / BLOCK bags, and gives at most a row for
    each component of each two blocks.
    """
    sizes = scratch.keep(members.select("node", "component", "bytes").distinct().groupBy("component").agg(F.count("*").alias("c"), F.sum("bytes").alias("b")))
    most = scratch.keep(members.select("key", "component").distinct().join(sizes, "component"))
    largest = most.groupBy("key").agg(F.max(F.struct("c", "component")).alias("l"))
    near = scratch.keep(most.join(largest, "key").groupBy("component", "c", "b").agg(F.max("l")["component"].alias("near")))
    own = (F.col("c") >= BLOCK) | (F.col("b") >= BLOCK_BYTES)
    around = near.where(~own).groupBy("near").agg(F.sum("c").alias("others"), F.sum("b").alias("other_bytes"))
    blocks_of = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES))
    rows = members.select("key", "node", "component").join(near.join(around, "near", "left"), "component")
    nr = F.when(own, F.pmod(F.xxhash64("node"), blocks_of(F.col("c"), F.col("b")))).otherwise(F.pmod(F.xxhash64("component"), blocks_of(F.col("others"), F.col("other_bytes"))))
    rows = rows.withColumn("owner", F.when(own, F.col("component")))
    rows = scratch.keep(rows.select("key", "node", "component", "owner", F.xxhash64(F.coalesce("owner", "near"), F.col("owner").isNull(), nr).alias("block")))
    names = scratch.keep(rows.select("key", "owner", "block").distinct())
    other = names.select("key", F.col("owner").alias("owner_b"), F.col("block").alias("block_b"))
    cells = names.join(other, "key").where("block <= block_b").where(~F.coalesce(F.col("owner") == F.col("owner_b"), F.lit(False)))
    cells = scratch.keep(cells.select("block", "block_b").distinct())
    placed = scratch.keep(rows.select("node", "component", "block").distinct())
    # These are few of all texts that have a bag; the bags of the others needn't be shuffled to find that out.
    texts = bags_.join(maybe_broadcast(placed, placed.count(), 24), "node").groupBy("block").agg(F.collect_list(F.struct("node", "component", "bag")).alias("texts"))
    texts = scratch.keep(texts)
    met = cells.join(texts, "block").join(texts.toDF("block_b", "texts_b"), "block_b").select("texts", "texts_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                sides = []
                for column in (0, 1):
                    rows = batch.column(column)[i].values
                    node, of = (np.asarray(rows.field(c)) for c in (0, 1))
                    sides.append((node, of, [np.frombuffer(x.as_buffer(), U) for x in rows.field(2)]))
                (a, of_a, x), (b, of_b, y) = sides
                hits = joining(x, y, of_a, of_b, least)
                yield pa.RecordBatch.from_arrays([pa.array(a[[h[0] for h in hits]] if hits else a[:0]), pa.array(b[[h[1] for h in hits]] if hits else b[:0])], ["a", "b"])
            release_memory()

    found = met.mapInArrow(run, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, *, least: float = 0.8, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The class of near duplicates of each document: id, class_id (its smallest id), class_size, kept.

    Two texts are linked when the weighted Jaccard similarity of their shingles is at least `least`; classes are what links
    connect. Texts are compared in lower case with one space between words; texts that are then equal are of one class,
    empty and null ones too, and are compared with others once. kept: the row with the smallest id of its class, and rows that repeat
    it with an equal text or one of the same class. An id that comes with several texts is a document for each of them; null ids are
    a class each text of their own. An empty table gives an empty result; other columns are not read.

    A link shows as a candidate if any of the bands agree: at a similarity of 0.8 all but 5 in 10**8. Buckets of any size are
    handled alike: each text is compared with one other of its bucket; then texts of different classes that still share a bucket
    are compared in blocks, of which only links that join two classes come out. So classes are those of all links in any bucket, and no
    pairs of a group are listed.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    given = pick(docs, id=id_col, text=text_col)
    kind = given.schema["id"].dataType.simpleString()
    signed = scratch.keep(given.mapInArrow(_sign(shingle, bands, rows), f"id {kind}, digest binary, size long, keys array<long>"))
    # A node is a text; equal texts are one.
    reps = signed.where("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id"), F.max("size").alias("size"), F.first("keys").alias("keys"))
    reps = scratch.keep(reps.withColumn("node", F.monotonically_increasing_id()))

    flat = reps.where("size > 0").select("node", "size", F.explode("keys").alias("key"))
    counts = scratch.keep(flat.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    cand = scratch.keep(flat.join(maybe_broadcast(counts, counts.count(), 16), "key").select("key", "node", "size", "n"))

    nodes = cand.select("node").distinct().join(reps.select("node", "id", "digest"), "node")
    nodes = scratch.keep(nodes)
    texts = given.join(maybe_broadcast(nodes, nodes.count(), 48), "id").select("node", "digest", "text")
    bags_ = scratch.keep(texts.mapInArrow(_elements(shingle), "node long, bag binary").dropDuplicates(["node"]))

    tried = scratch.keep(_stars(cand, scratch))
    a, b = bags_.toDF("a", "x"), bags_.toDF("b", "y")
    links = scratch.keep(tried.join(a, "a").join(b, "b").select("a", "b", "x", "y").mapInArrow(_overlap(least), "a long, b long"))
    parts = components(links, scratch)
    members = _open(cand, parts, scratch)
    if members.limit(1).count():
        links = scratch.keep(links.unionByName(_joined(members, bags_, least, scratch)))
        parts = components(links, scratch)

    classes = reps.select("digest", "id", "node").join(parts, "node", "left").select("digest", "id", F.coalesce("component", "node").alias("component"))
    classes = scratch.keep(classes)
    names = classes.groupBy("component").agg(F.min("id").alias("class_id"))
    out = signed.select("id", "digest").join(classes.select("digest", "component").join(names, "component").drop("component"), "digest", "left")
    out = scratch.keep(out.select("id", F.when(F.col("id").isNotNull(), F.col("class_id")).alias("class_id")))
    sizes = out.groupBy("class_id").agg(F.count("*").alias("class_size"))
    out = out.join(sizes, "class_id", "left").select("id", "class_id", F.when(F.col("id").isNull(), F.lit(1)).otherwise(F.col("class_size")).cast("long").alias("class_size"), F.col("id").eqNullSafe(F.col("class_id")).alias("kept"))
    return out.withColumnRenamed("id", id_col)
