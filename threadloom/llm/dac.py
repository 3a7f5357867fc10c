"""Token files of directly addressable codes.

A file is a Parquet table of segments in ascending order of document. A segment holds the ids of consecutive
documents, each id split into chunks of 8 bits, lowest first. Level k holds the k-th chunk of every id that has one,
a bitmap tells which of them go on to level k + 1, and a rank directory holds the number of set bits before each
block of 512 bits. So the id at any place is read from a byte a level and one rank a level, without decoding others.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import codec, encoded, load_spec
from .common import Scratch, maybe_broadcast, pick

BLOCK = 512
#: Ids in a segment at least, unless the partition ends; a document is never cut.
SEGMENT = 1 << 20
#: Fixed value of this format: the first bytes of a segment.
MAGIC = b"DAC1"


def pack(ids: np.ndarray) -> bytes:
    """The code of some ids: number of ids and of levels, then for each level its length, bytes, bitmap and ranks."""
    out, left, levels = [], np.asarray(ids, np.uint32), 0
    while True:
        more = left > 0xFF
        ranks = np.concatenate([[0], np.cumsum(np.add.reduceat(more, np.arange(0, len(left), BLOCK)))[:-1]]) if len(left) else np.zeros(0)
        out.append(np.array([len(left)], "<u4").tobytes() + (left & 0xFF).astype(np.uint8).tobytes() + np.packbits(more, bitorder="little").tobytes() + ranks.astype("<u4").tobytes())
        levels += 1
        left = left[more] >> 8
        if not len(left):
            return MAGIC + np.array([len(ids), levels], "<u4").tobytes() + b"".join(out)


class Reader:
    """Random access to a segment."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a segment")
        self.n, levels = np.frombuffer(data, "<u4", 2, 4).tolist()
        self.levels, at = [], 12
        for _ in range(levels):
            n = int(np.frombuffer(data, "<u4", 1, at)[0])
            chunks = np.frombuffer(data, np.uint8, n, at + 4)
            bits = np.frombuffer(data, np.uint8, (n + 7) // 8, at + 4 + n)
            blocks = -(-n // BLOCK)
            ranks = np.frombuffer(data, "<u4", blocks, at + 4 + n + len(bits))
            self.levels.append((chunks, bits, ranks))
            at += 4 + n + len(bits) + 4 * blocks

    def rank(self, k: int, i: int) -> int:
        """Set bits of level k before place i."""
        _, bits, ranks = self.levels[k]
        if not len(ranks):
            return 0
        b = min(i // BLOCK, len(ranks) - 1)
        some = np.unpackbits(bits[b * BLOCK // 8 : -(-i // 8)], bitorder="little", count=i - b * BLOCK)
        return int(ranks[b]) + int(some.sum())

    def get(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for k, (chunks, bits, _) in enumerate(self.levels):
            out |= int(chunks[i]) << 8 * k
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            i = self.rank(k, i)
        return out

    def slice(self, start: int, end: int) -> np.ndarray:
        """The ids from start to end: on each level a range between two ranks."""
        out, where = np.zeros(end - start, "<u4"), np.arange(end - start)
        for k, (chunks, bits, _) in enumerate(self.levels):
            if start >= end:
                break
            out[where] |= chunks[start:end].astype(np.uint32) << np.uint32(8 * k)
            more = np.unpackbits(bits[start >> 3 : -(-end // 8)], bitorder="little")[start & 7 :][: end - start].astype(bool)
            where, start = where[more], self.rank(k, start)
            end = start + len(where)
        return out


def write_tokens(docs: DataFrame, path: str, to: str, *, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> None:
    """Encodes each text, appends end_id and writes the ids in ascending order of id_col (nulls first) to folder `to`.

    Rows of the same id are in order of their text. Null and empty texts have only end_id. Range
    partitions follow the order, so files and the segments in them do too; a partition's text is never held whole.
    """
    held = docs.sparkSession.sparkContext.broadcast(load_spec(path))
    rows = pick(docs, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType.simpleString()
    rows = rows.repartitionByRange(*([partitions] if partitions else []), "id").sortWithinPartitions("id", "text").select(F.spark_partition_id().alias("part"), "id", "text")
    schema = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("n_ids", pa.int64()), ("ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("data", pa.binary())])
    end = np.array([] if end_id is None else [end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, segment, ids, ends, codes, n = codec(held.value), 0, [], [], [], 0

        def flush() -> pa.RecordBatch:
            code = pack(np.frombuffer(b"".join(codes), "<u4"))
            return pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip((part, segment, n, ids, ends, code), schema, strict=True)], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(0)[0].as_py()
            for i, got in zip(batch.column(1).to_pylist(), encoded(c, batch.column(2)), strict=True):
                codes.append(got + end)
                n += len(codes[-1]) // 4
                ids.append(i)
                ends.append(n)
                if n >= SEGMENT:
                    yield flush()
                    segment, ids, ends, codes, n = segment + 1, [], [], [], 0
        if ids:
            yield flush()

    rows.mapInArrow(run, f"part int, segment int, n_ids long, ids array<{kind}>, ends array<long>, data binary").write.option("compression", "uncompressed").parquet(to)


def read_tokens(spark, path: str, *, id_col: str = "doc_id", id_type: str = "bigint", full: bool = False) -> DataFrame:
    """Reads such files: per document id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as
    little-endian unsigned 32-bit integers) and with full=True the ids."""
    files = spark.read.parquet(path)
    segments = files.select("part", "segment", "n_ids")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    in_part = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    bases = segments.withColumn("inner", F.coalesce(F.sum("n_ids").over(in_part), F.lit(0))).join(parts, "part").select("part", "segment", (F.col("base") + F.col("inner")).alias("base"))
    schema = f"part int, segment int, id {id_type}, inside long, n_tokens long, ids_crc32 long" + ", ids array<long>" * full

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data, start, crcs, lists = Reader(row["data"]), [0, *row["ends"][:-1]], [], []
                ids = data.slice(0, data.n)  # every document is read, so all levels at once
                for a, b in zip(start, row["ends"], strict=True):
                    got = ids[a:b]
                    crcs.append(zlib.crc32(got))
                    if full:
                        lists.append(got.astype(np.int64))
                n = len(start)
                cols = [pa.array([row["part"]] * n, pa.int32()), pa.array([row["segment"]] * n, pa.int32()), pa.array(row["ids"], batch.schema.field("ids").type.value_type), pa.array(start, pa.int64()), pa.array(np.subtract(row["ends"], start), pa.int64()), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(lists, pa.list_(pa.int64()))] * full, [x.split()[0] for x in schema.split(", ")])

    rows = files.select("part", "segment", "ids", "ends", "data").mapInArrow(run, schema)
    bases = maybe_broadcast(bases, segments.count(), 16)
    return rows.join(bases, ["part", "segment"]).select(F.col("id").alias(id_col), (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * full)


def token_files(docs: DataFrame, path: str, *, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text", to: str | None = None) -> DataFrame:
    """Writes the files and reads them back; see write_tokens and read_tokens. An empty table gives an empty result."""
    spark = docs.sparkSession
    to = to or Scratch(spark, "tokens").path
    write_tokens(docs, path, to, end_id=end_id, id_col=id_col, text_col=text_col)
    kind = pick(docs, id=id_col).schema["id"].dataType.simpleString()
    return read_tokens(spark, to, id_col=id_col, id_type=kind)
