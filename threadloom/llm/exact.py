"""Exact duplicates by a log-structured merge index, in DataFrame functions only.

Each task is a memtable: it flushes its documents' digests as one sorted run. A compaction merges the runs by digest and keeps one
identifier and the number of documents of each; a bitmap filter of the digests that came more than once lets through only
the texts that may have an equal. Of these hits the bytes are compared: where all texts of a digest are the same, the compacted
identifier is final; where they differ, each text gets its own. Texts that come once never shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, LOWER, UPPER, Scratch, maybe_broadcast, pick

#: Filter bits for each repeated digest.
BITS = 32
#: Fixed value: bits in one bitmap of bitmap_construct_agg.
BITMAP = 32768


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def flush_runs(docs: DataFrame, scratch: Scratch, normalise, digest_bits: int) -> DataFrame:
    """Sorted runs of (id, sha, digest), one for each task."""
    sha = F.unhex(F.sha2(normalise(F.col("text")), 256))
    runs = scratch.keep(docs.select("id", sha.alias("sha")).sortWithinPartitions("sha"))
    return runs.withColumn("digest", F.substring("sha", 1, digest_bits // 8))


def compact(runs: DataFrame, keep: str) -> DataFrame:
    """Merges runs: one row a digest that came more than once, with the identifier that stays and the number of rows. Each task merges what
    it has read before anything is exchanged, so a digest of very many rows costs one row a task."""
    return runs.groupBy("digest").agg((F.max if keep == "max" else F.min)("id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")


def repeat_filter(repeated: DataFrame, slots: int) -> DataFrame:
    slot = _slot(slots)
    return repeated.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))


def _slot(slots: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(slots)) + 1


def probe(rows: DataFrame, bitmaps: DataFrame, slots: int) -> DataFrame:
    """Rows whose digest may be in the filter."""
    slot = _slot(slots)
    bit = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring("bits", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.getbit(byte, F.pmod(bit, F.lit(8)).cast("int")) == 1
    with_bucket = rows.withColumn("bucket", F.bitmap_bucket_number(slot))
    return with_bucket.join(F.broadcast(bitmaps), "bucket").where(hit).drop("bucket", "bits")


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", normalise=ascii_lower, digest_bits: int = 256) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 (of the normalised text, UTF-8).

    Texts are equal when their normalised forms are (by default A-Z in lower case); null counts as empty. Of equal
    texts the row with the largest id stays (keep="min": smallest); ids that are null stay only if all are. Rows that
    repeat the id that stays count in group_size and are all marked kept. An empty table gives an empty result. Equal
    digests of different texts (which tests bring about by digest_bits) are told apart by their bytes.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    rows = pick(docs, id=id_col, text=text_col).select("id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    runs = flush_runs(rows, scratch, normalise, digest_bits)
    compacted = scratch.keep(compact(runs, keep))
    n = compacted.count()

    texts = rows.select("id", normalise(F.col("text")).alias("text")).withColumn("digest", F.substring(F.unhex(F.sha2("text", 256)), 1, digest_bits // 8))
    if n * BITS // 8 <= BROADCAST_BYTES:  # beyond that the texts are joined with the repeated digests by a shuffle
        slots = BITMAP * (1 + n * BITS // BITMAP)
        hits = probe(texts, repeat_filter(compacted, slots), slots)
    else:
        hits = texts.join(compacted.select("digest"), "digest", "left_semi")
    # Byte verification: each task compares its own texts of a digest first, so a large group meets as one row a task.
    differ = hits.groupBy("digest").agg(F.min("text").alias("low"), F.max("text").alias("high")).where("low <> high").select("digest")
    differ = scratch.keep(differ)
    clashes = differ.count()
    differ = maybe_broadcast(differ, clashes, digest_bits // 8 + 16)

    final = compacted.join(differ, "digest", "left_anti") if clashes else compacted
    plain = runs.join(differ, "digest", "left_anti") if clashes else runs
    one = maybe_broadcast(final, n, digest_bits // 8 + 32)
    out = plain.join(one, "digest", "left").select("id", F.coalesce("keep_id", "id").alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), F.lower(F.hex("sha")).alias("text_sha256"))
    if clashes:
        own = hits.join(differ, "digest", "left_semi")
        agreed = own.groupBy("digest", "text").agg((F.max if keep == "max" else F.min)("id").alias("keep_id"), F.count("*").alias("group_size"))
        own = own.join(agreed, ["digest", "text"]).select("id", "keep_id", "group_size", F.sha2("text", 256).alias("text_sha256"))
        out = out.unionByName(own)
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
