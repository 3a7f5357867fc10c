"""Which texts are equal to, or stand in, which others: any length, no plain join of all with all.

Equal texts are one class. A text of GRAM characters or more has an anchor: of the SKETCH windows of that length with the
smallest hashes, the one that the fewest texts have in theirs; a shorter text is its own anchor. Windows of all texts that may be
an anchor (a bitmap lets through the others rarely) are spots where a text may stand; there the digest of the characters decides.
Shorter texts are looked for only where their first characters (HEADS) stand, so few window lengths are hashed at every place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import kept

#: Characters of a window, and windows that are looked at for an anchor.
GRAM, SKETCH = 24, 16
#: Tables of at most so many rows are broadcast; bits of the bitmap for each anchor, and at most.
BROADCAST_ROWS, BITS, MOST_BITS = 300_000, 32, 1 << 29
#: Characters at the start of a shorter text, of which the most that it has are looked for first.
HEADS = (8, 4, 2, 1)
_BASE, _SPREAD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(first: int, base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.array([first], np.uint64), np.full(n - 1, base, np.uint64)]), dtype=np.uint64)


class _Windows:
    """Hashes of windows of a text, for any window length; they spread in their high bits."""

    def __init__(self):
        self.up = self.down = np.ones(0, np.uint64)

    def read(self, text: str) -> int:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        n = self.n = len(codes)
        if len(self.up) < n:
            self.up, self.down = _powers(1, _BASE, 2 * n), _powers(_SPREAD, _INVERSE, 2 * n)
        codes *= self.up[:n]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(codes, out=self.sums[1:])
        return n

    def all(self, size: int) -> np.ndarray:
        """Of each place where a window of this length fits."""
        h = self.sums[size:] - self.sums[: self.n - size + 1]
        h *= self.down[: len(h)]
        h += np.uint64(size * _BASE & (1 << 64) - 1)
        return h

    def some(self, size: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (self.sums[at + size] - self.sums[at]) * self.down[at] + size.astype(np.uint64) * np.uint64(_BASE)


def _head(size: int) -> int:
    return next(n for n in HEADS if n <= size)


def _texts(batches: Iterator[pa.RecordBatch], *cols: int) -> Iterator[tuple]:
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            yield from zip(*(batch.column(c).slice(i, 256).to_pylist() for c in cols), strict=True)


def _out(rows: Iterator[tuple], schema: pa.Schema, most: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Rows (constants and arrays of one length) as batches."""
    some, n = [], 0
    for size, *cols in rows:
        some.append([c if isinstance(c, np.ndarray) else [c] * size for c in cols])
        n += size
        if n >= most:
            yield from _batch(some, schema)
            some, n = [], 0
    if some:
        yield from _batch(some, schema)


def _batch(some: list, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if isinstance(c[0], np.ndarray) else [x for part in c for x in part], t) for c, t in zip(zip(*some, strict=True), schema.types, strict=True)], schema=schema)


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _anchors(texts: DataFrame) -> DataFrame:
    """(d, h, off, size, head) of each text (d, k): the one of its SKETCH windows with the smallest hashes that the fewest texts have in
    theirs, where it stands, the text's length, and the hash of the first characters of a text that is shorter than a window."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = _Windows()

        def each():
            for d, k in _texts(batches, 0, 1):
                n = windows.read(k)
                h = windows.all(min(n, GRAM)).view(np.int64)
                first = np.argpartition(h, SKETCH)[:SKETCH] if len(h) > SKETCH else np.arange(len(h))
                h, at = np.unique(h[first], return_index=True)
                head = windows.some(np.array([_head(n)]), np.zeros(1, np.int64)).view(np.int64)[0] if n < GRAM else h[0]
                yield len(h), d, n, h, first[at].astype(np.int32), np.full(len(h), head)

        yield from _out(each(), pa.schema([("d", pa.binary()), ("size", pa.int32()), ("h", pa.int64()), ("off", pa.int32()), ("head", pa.int64())]))

    sketches = kept(texts.select("d", "k").mapInArrow(sketch, "d binary, size int, h long, off int, head long"), "sketches")
    often = sketches.groupBy("h").agg(F.count("*").alias("n"))
    return sketches.join(often, "h").groupBy("d").agg(F.min_by(F.struct("h", "off", "size", "head"), F.struct("n", "h")).alias("a")).select("d", "a.*")


def _spots(texts: DataFrame, kind: str, anchors: DataFrame, whole: bool) -> DataFrame:
    """(d, spots) of the texts (d, k): where a text of one of the anchors may stand; `whole`: also one as long as the text itself."""
    spark = texts.sparkSession
    spots = kept(anchors.select("h", "off", "size", "head").distinct(), "spots")
    n_spots = spots.count()
    log = min(MOST_BITS, 1 << max(20, (BITS * n_spots).bit_length())).bit_length() - 1
    lengths = sorted(r.n for r in spots.select(F.least("size", F.lit(GRAM)).alias("n")).distinct().collect())
    heads = {n: np.array([size for size in lengths if size < GRAM and _head(size) == n], np.int64) for n in HEADS}
    bitmap = np.zeros(1 << log - 3, np.uint8)
    hashes = spots.select("h").unionByName(spots.where(F.col("size") < GRAM).select(F.col("head").alias("h")))
    bit = F.shiftrightunsigned("h", 64 - log)
    for r in hashes.groupBy(F.shiftright(bit, 15).alias("part")).agg(F.bitmap_construct_agg(bit.bitwiseAND(32767)).alias("b")).toLocalIterator():
        bitmap[r.part * 4096 : (r.part + 1) * 4096] = np.frombuffer(r.b, np.uint8)
    held = spark.sparkContext.broadcast(bitmap.tobytes())
    d_type = pa.binary() if kind == "binary" else pa.int64()

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, known = _Windows(), np.frombuffer(held.value, np.uint8)

        def maybe(h: np.ndarray) -> np.ndarray:
            b = (h >> np.uint64(64 - log)).view(np.int64)
            return np.flatnonzero((known[b >> 3] >> (b & 7).astype(np.uint8)) & 1)

        def each():
            for d, k in _texts(batches, 0, 1):
                n = windows.read(k or "")
                if lengths[-1:] == [GRAM] and n >= GRAM:
                    h = windows.all(GRAM)
                    if len(at := maybe(h)):
                        yield len(at), d, n, h[at].view(np.int64), at.astype(np.int32)
                for head, sizes in heads.items():
                    if not len(sizes) or n < sizes[0] or not len(begin := maybe(windows.all(head))):
                        continue
                    at, size = np.repeat(begin, len(sizes)), np.tile(sizes, len(begin))
                    at, size = at[fit := at + size <= n], size[fit]
                    h = windows.some(size, at)
                    if len(found := maybe(h)):
                        h, first = np.unique(h[found], return_index=True)
                        yield len(h), d, n, h.view(np.int64), at[found[first]].astype(np.int32)

        yield from _out(each(), pa.schema([("d", d_type), ("n", pa.int32()), ("h", pa.int64()), ("at", pa.int32())]))

    seen = texts.select("d", "k").mapInArrow(look, f"d {kind}, n int, h long, at int").join(_small(spots.drop("head"), n_spots), "h")
    start = F.col("at") - F.col("off")
    shorter = F.lit(True) if whole else F.col("size") < F.col("n")
    maybe = seen.where((start >= 0) & (start + F.col("size") <= F.col("n")) & shorter)
    return maybe.groupBy("d").agg(F.collect_set(F.struct(start.alias("start"), "size")).alias("spots"))


def quotes_in(docs: DataFrame, quotes: DataFrame) -> DataFrame:
    """(doc, quote) ids of the quotes that stand in documents: docs (id, text), quotes (id, text). Quotes are looked for as they are; a quote
    that stands in a text several times gives one row, rows that repeat are rows of their own. Null and empty quotes are in no text."""
    q = quotes.toDF("quote", "k").where("k <> ''").withColumn("d", F.unhex(F.sha2("k", 256)))
    classes = kept(q.select("d", "k").dropDuplicates(["d"]), "quotes")
    rows = kept(docs.toDF("doc", "k").select(F.monotonically_increasing_id().alias("d"), "doc", "k"), "quoted")
    maybe = kept(_spots(rows, "bigint", _anchors(classes), True), "maybe")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for nr, k, found in _texts(batches, 0, 1, 2):
                for d in {hashlib.sha256(k[s["start"] : s["start"] + s["size"]].encode()).digest() for s in found}:
                    yield 1, nr, d

        yield from _out(each(), pa.schema([("nr", pa.int64()), ("d", pa.binary())]))

    hits = rows.join(_small(maybe, maybe.count()), "d").select("d", "k", "spots").mapInArrow(cut, "nr long, d binary").join(q.select("quote", "d"), "d")
    return rows.select(F.col("d").alias("nr"), "doc").join(hits.select("nr", "quote"), "nr").select("doc", "quote")


def text_containment(rows: DataFrame, id_: str, key: str) -> DataFrame:
    """(relation, inner_id, outer_id) of texts that aren't null or empty.

    equal: a text and the smallest id of its class, for each other id of the class; contained: the smallest ids of two
    classes, of which the outer's text has the inner's in it. So a pair of ids is near when both are of one class, or their
    classes are a contained pair. Rows that repeat are one; ids must be unique otherwise.
    """
    mine = rows.select(F.col(id_).alias("id"), F.col(key).alias("k")).where("k <> ''")
    mine = kept(mine.withColumn("d", F.unhex(F.sha2("k", 256))), "texts")  # the key may be dear, and is read twice
    classes = kept(mine.groupBy("d").agg(F.min("id").alias("id"), F.first("k").alias("k")), "classes")
    n = classes.count()

    maybe = _spots(classes.select("d", "k"), "binary", _anchors(classes), False)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for outer, k, found in _texts(batches, 0, 1, 2):
                for d in {hashlib.sha256(k[s["start"] : s["start"] + s["size"]].encode()).digest() for s in found}:
                    yield 1, outer, d

        yield from _out(each(), pa.schema([("outer_id", pa.from_numpy_dtype(np.int64) if kind == "bigint" else pa.string()), ("d", pa.binary())]))

    kind = "bigint" if dict(classes.dtypes)["id"] in ("bigint", "int") else "string"
    ids = classes.select("d", F.col("id").cast(kind).alias("id"))
    cuts = classes.select("d", F.col("id").cast(kind).alias("id"), "k").join(maybe, "d").select("id", "k", "spots").mapInArrow(cut, f"outer_id {kind}, d binary")
    contained = cuts.join(_small(ids.withColumnRenamed("id", "inner_id"), n), "d").select(F.lit("contained").alias("relation"), "inner_id", "outer_id")
    equal = mine.select("d", F.col("id").cast(kind).alias("inner_id")).distinct().join(_small(ids.withColumnRenamed("id", "outer_id"), n), "d").where("inner_id <> outer_id")
    return contained.unionByName(equal.select(F.lit("equal").alias("relation"), "inner_id", "outer_id"))
