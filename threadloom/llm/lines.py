"""Lines that many documents share, found with two Bloom filters.

Each task keeps a filter of the line hashes it has seen once and one of those it has seen again. Merged over all
tasks, a line whose bits are set in the second filter may be repeated; all others are surely not. Only the suspected
lines shuffle, and they are counted exactly. The filters' size follows the number of lines up to a bound; when they are too small for the
data, more lines are suspected and shuffled, and the result is the same. Filters are merged by piece in two steps, first those of some
tasks, so that no task meets a piece of every other task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, Scratch, pick, release_memory

#: Fixed value: the white space stripped from both ends of a line.
STRIP = b" \t\n\x0b\x0c\r"
#: Bits of each filter, as a power of two, at least and at most (16 MB); bits for each line.
LEAST_LOG_BITS, MOST_LOG_BITS, LINE_BITS = 20, 27, 8
#: Bits set for a line.
HASHES = 3
#: Bytes of a filter that are merged together; neighbouring tasks whose filters are merged first, and groups of these at most.
PIECE, TOGETHER, GROUPS = 1 << 15, 16, 256


def line_key(line: bytes) -> bytes:
    return line.strip(STRIP).lower()  # of bytes: A-Z only


def _places(keys: list[bytes], log_bits: int) -> np.ndarray:
    """The bits of each key, HASHES columns."""
    h = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))
    step = (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([(h + step * np.uint64(i)) & np.uint64((1 << log_bits) - 1) for i in range(HASHES)], 1).astype(np.int64)


def _has(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    return ((bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1).all(1)


def _set(bits: np.ndarray, places: np.ndarray) -> None:
    flat = places.ravel()
    np.bitwise_or.at(bits, flat >> 3, np.left_shift(1, flat & 7).astype(np.uint8))


def _documents(batch: pa.RecordBatch, column: int) -> Iterator[list[bytes]]:
    """The lines of each document of a batch."""
    col = batch.column(column)
    for i in range(0, len(col), 256):
        for t in col.slice(i, 256).cast(pa.binary()).to_pylist():
            yield (t or b"").split(b"\n")


def _group(task: int) -> int:
    """The group of tasks whose filters are merged first. There are few groups where there are few tasks, so that little is left to be
    merged a second time, and never more than GROUPS."""
    return task // TOGETHER % GROUPS


def filter_bits(rows: DataFrame) -> int:
    """The size of a filter for the lines of the texts, as a power of two."""
    n = rows.agg(F.coalesce(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1), F.lit(0)).alias("n")).first().n
    return min(MOST_LOG_BITS, max(LEAST_LOG_BITS, (LINE_BITS * n).bit_length()))


def repeat_filter(rows: DataFrame, min_chars: int, log_bits: int) -> bytes:
    """The filter of keys that more than one document may have."""

    def see(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(1 << log_bits - 3, np.uint8), np.zeros(1 << log_bits - 3, np.uint8)
        for batch in batches:
            keys: list[bytes] = []
            for lines in _documents(batch, 0):
                keys += {k for k in map(line_key, lines) if k and len(k.decode()) >= min_chars}
                if len(keys) > 50_000:
                    _see(keys, once, twice, log_bits)
                    keys = []
            _see(keys, once, twice, log_bits)
        release_memory()
        for i in range(0, len(once), PIECE):
            if once[i : i + PIECE].any():
                yield pa.RecordBatch.from_pydict({"piece": pa.array([i // PIECE], pa.int32()), "some": pa.array([_group(TaskContext.get().partitionId())], pa.int32()), "once": [once[i : i + PIECE].tobytes()], "twice": [twice[i : i + PIECE].tobytes()]})

    def merge(pdf):
        once, twice = np.zeros(PIECE, np.uint8), np.zeros(PIECE, np.uint8)
        for a, b in zip(pdf["once"], pdf["twice"], strict=True):
            a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
            twice[: len(b)] |= b | once[: len(a)] & a
            once[: len(a)] |= a
        return pdf.iloc[:1].assign(once=[once.tobytes()], twice=[twice.tobytes()])

    schema = "piece int, some int, once binary, twice binary"
    pieces = rows.select("text").mapInArrow(see, schema).groupBy("piece", "some").applyInPandas(merge, schema).groupBy("piece").applyInPandas(merge, schema)
    out = np.zeros(1 << log_bits - 3, np.uint8)
    for r in pieces.select("piece", "twice").toLocalIterator():
        out[r.piece * PIECE : r.piece * PIECE + PIECE] = np.frombuffer(r.twice, np.uint8)[: max(0, len(out) - r.piece * PIECE)]
    return out.tobytes()


def _see(keys: list[bytes], once: np.ndarray, twice: np.ndarray, log_bits: int) -> None:
    if not keys:
        return
    places = _places(keys, log_bits)
    _, first, count = np.unique(places[:, :2] @ np.array([1 << 32, 1]), return_index=True, return_counts=True)
    again = _has(once, places)
    _set(twice, places[again])
    _set(twice, places[first[count > 1]])
    _set(once, places)


def common_lines(rows: DataFrame, min_docs: int, min_chars: int, log_bits: int, scratch: Scratch) -> DataFrame:
    """The keys that at least min_docs documents have, with their number of documents, and the number of the first line
    among all its documents' (id, line number)."""
    held = rows.sparkSession.sparkContext.broadcast(repeat_filter(rows, min_chars, log_bits))
    kind = rows.schema["id"].dataType.simpleString()

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(held.value, np.uint8)
        for batch in batches:
            ids = batch.column(0)
            at, keys, where = [], [], []

            def out() -> pa.RecordBatch:
                ok = np.flatnonzero(_has(bits, _places(keys, log_bits))).tolist() if keys else []
                return pa.RecordBatch.from_arrays([pa.array([keys[i] for i in ok], pa.binary()), ids.take(pa.array([at[i] for i in ok], pa.int64())), pa.array([where[i] for i in ok], pa.int32())], ["key", "id", "line"])

            for i, lines in enumerate(_documents(batch, 1)):
                seen = {}
                for j, x in enumerate(lines):
                    k = line_key(x)
                    if k and k not in seen and len(k.decode()) >= min_chars:
                        seen[k] = j
                keys += seen
                where += seen.values()
                at += [i] * len(seen)
                if len(keys) > 50_000:
                    yield out()
                    at, keys, where = [], [], []
            yield out()
            release_memory()

    found = rows.select("id", "text").mapInArrow(suspects, f"key binary, id {kind}, line int")
    return scratch.keep(found.groupBy("key").agg(F.count("*").alias("n_docs"), F.min(F.struct("id", "line")).alias("first")).where(F.col("n_docs") >= min_docs))


def drop_lines(docs: DataFrame, *, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, carry: list[str] = (), id_col: str = "doc_id", text_col: str = "text", log_bits: int | None = None, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Each document without the lines that at least min_docs documents have.

    A text is cut at \\n (null and empty: one empty line). A line's key is the line without `[\\x20\\x09-\\x0D]` at both
    ends, A-Z in lower case; keys of fewer than min_chars code points always stay. A document counts once for a key
    however often it has it; rows that repeat an id count as documents. With keep_first the first such line, by
    id and place, stays. Returns a row per row: id, n_lines, n_dropped, kept_sha256, text (what stays, joined by \\n) and
    row (a struct of the columns to carry along). An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    rows = pick(docs, id=id_col, text=text_col, **{f"c{i}": c for i, c in enumerate(carry)})
    rows = rows.select("id", "text", F.struct(*(F.col(f"c{i}").alias(c) for i, c in enumerate(carry))).alias("row")) if carry else rows.withColumn("row", F.lit(None).cast("int"))
    kind, row_kind = (rows.schema[c].dataType.simpleString() for c in ("id", "row"))
    common = common_lines(rows, min_docs, min_chars, log_bits or filter_bits(rows), scratch)
    size = common.agg(F.coalesce(F.sum(F.octet_length("key") + 24), F.lit(0)).alias("n")).first().n
    schema = f"id {kind}, n_lines long, n_dropped long, kept_sha256 string, text string, row {row_kind}"

    def cut(batch: pa.RecordBatch, stays) -> pa.RecordBatch:
        n, dropped, shas, kept = [], [], [], []
        for i, lines in enumerate(_documents(batch, 1)):
            left = [x for j, x in enumerate(lines) if stays(i, j, x)]
            n.append(len(lines))
            dropped.append(len(lines) - len(left))
            kept.append(b"\n".join(left))
            shas.append(hashlib.sha256(kept[-1]).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(shas, pa.string()), pa.array(kept, pa.binary()).cast(pa.string()), batch.column(2)], ["id", "n_lines", "n_dropped", "kept_sha256", "text", "row"])

    if size <= most_bytes:
        held = spark.sparkContext.broadcast({bytes(r.key): (r.first.id, r.first.line) for r in common.toLocalIterator()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            gone = held.value
            for batch in batches:
                ids = batch.column(0).to_pylist()
                if keep_first:
                    yield cut(batch, lambda i, j, x, ids=ids: (k := line_key(x)) not in gone or gone[k] == (ids[i], j))
                else:
                    yield cut(batch, lambda i, j, x: line_key(x) not in gone)

        return rows.select("id", "text", "row").mapInArrow(run, schema).withColumnRenamed("id", id_col)

    # Too many common lines for each task to hold: the lines join them, and the numbers of those to drop go to their documents.
    whole = rows.select(F.monotonically_increasing_id().alias("nr"), "id", "text", "row")
    whole = scratch.keep(whole)  # so that row numbers don't change between its two uses
    lines = whole.select("nr", "id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line", "x"))
    key = F.translate(F.regexp_replace("x", r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = lines.withColumn("key", F.encode(key, "UTF-8")).join(common, "key")
    if keep_first:
        hit = hit.where(~(F.col("first") == F.struct("id", "line")))
    gone = hit.groupBy("nr").agg(F.collect_list("line").alias("gone"))

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drop = [set(x or ()) for x in batch.column(3).to_pylist()]
            yield cut(batch, lambda i, j, x, drop=drop: j not in drop[i])

    return whole.join(gone, "nr", "left").select("id", "text", "row", "gone").mapInArrow(run_joined, schema).withColumnRenamed("id", id_col)
