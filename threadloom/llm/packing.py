"""Best-fit packing of documents into sequences of a fixed capacity, under conflicts.

Documents are dealt into shards of bounded size by a hash of their id, so a source or a group of copies of any size is
spread evenly; each shard is packed by itself. Bins are ordered by what is left in them. Each carries a bitmap of
its duplicate clusters and bitmaps of its sources (the k-th for sources that it holds k times), with a bit for each
cluster that repeats in the shard and for each source. A document goes to the successor of its length in that order,
and on to the next until a bin has no conflict: the tightest that fits.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick

#: Documents in a shard, about.
SHARD = 8192


def best_fit(items: list[tuple[int, int, int, int]], capacity: int, source_limit: int) -> list[tuple[int, int]]:
    """Items (length, key, bit of the cluster, bit of the source), longest first; a bit of -1 conflicts with nothing.
    Returns the bin and the offset of each."""
    left: list[tuple[int, int]] = []  # what is left of each open bin, and its number, in order
    clusters: list[int] = []
    sources: list[list[int]] = []
    out = []
    for length, _, cluster, source in items:
        c, s = 1 << cluster if cluster >= 0 else 0, 1 << source if source >= 0 else 0
        k = bisect_left(left, (length, -1))
        while k < len(left) and (clusters[left[k][1]] & c or sources[left[k][1]][-1] & s):
            k += 1
        if k < len(left):
            room, b = left.pop(k)
        else:
            room, b = capacity, len(clusters)
            clusters.append(0)
            sources.append([0] * source_limit)
        out.append((b, capacity - room))
        clusters[b] |= c
        for i, had in enumerate(sources[b]):
            if not had & s:
                sources[b][i] |= s
                break
        if room > length:
            insort(left, (room - length, b))
    return out


def pack(docs: DataFrame, *, capacity: int = 8192, source_limit: int = 16, shard: int = SHARD, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length_col: str | None = None, cluster_col: str | None = None) -> DataFrame:
    """Packs each document into bins of `capacity` words (or units of length_col).

    No bin holds two documents of the same cluster (by default: the same text), nor more than source_limit of a
    source. A document longer than a bin is cut into pieces of `capacity`, each full piece a bin of its own; only the
    last piece is packed. Returns a row per piece: id, piece (from 0), start and n_tokens (within the document), bin
    (shard and number), bin_offset. Null and empty texts have one piece of 0 tokens. Null sources are one source, null
    clusters conflict with nothing. Rows that repeat an id are documents of their own. Equal input gives an equal
    packing, however it is partitioned. An empty table gives an empty result.
    """
    more = {"source": source_col} | ({"length": length_col} if length_col else {}) | ({"cluster": cluster_col} if cluster_col else {})
    rows = pick(docs, id=id_col, **({} if length_col and cluster_col else {"text": text_col}), **more)
    length = F.col("length") if length_col else F.regexp_count("text", F.lit(r"\S+"))
    cluster = F.when(F.col("cluster").isNotNull(), F.xxhash64("cluster")) if cluster_col else F.xxhash64(F.coalesce("text", F.lit("")))
    rows = rows.select("id", F.greatest(F.coalesce(length, F.lit(0)), F.lit(0)).cast("long").alias("n"), cluster.alias("cluster"), F.xxhash64(F.coalesce("source", F.lit(""))).alias("source"))
    kind = rows.schema["id"].dataType.simpleString()
    shards = max(1, -(-docs.count() // shard))
    full = F.greatest(F.ceil(F.col("n") / capacity) - 1, F.lit(0))
    rows = rows.withColumn("full", full).withColumn("shard", F.pmod(F.xxhash64("id", "cluster"), F.lit(shards)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(rest=pdf["n"] - pdf["full"] * capacity, key=pdf["id"].astype(str)).sort_values(["rest", "key", "cluster", "n"], ascending=[False, True, True, True], na_position="last")
        items = list(zip(pdf["rest"].tolist(), range(len(pdf)), _bits(pdf["cluster"], 1), _bits(pdf["source"], source_limit), strict=True))
        placed = best_fit(items, capacity, source_limit)
        return pd.DataFrame({"id": pdf["id"].to_numpy(), "piece": pdf["full"].to_numpy(), "start": (pdf["full"] * capacity).to_numpy(), "n_tokens": pdf["rest"].to_numpy(), "bin": [f"{s}-{b}" for s, (b, _) in zip(pdf["shard"], placed, strict=True)], "bin_offset": [o for _, o in placed]})

    schema = f"id {kind}, piece long, start long, n_tokens long, bin string, bin_offset long"
    rest = rows.groupBy("shard").applyInPandas(run, schema)
    whole = rows.where("full > 0").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("full") - 1)))
    whole = whole.select("id", "piece", (F.col("piece") * capacity).alias("start"), F.lit(capacity).cast("long").alias("n_tokens"), F.concat_ws("-", F.lit("full"), F.hex(F.xxhash64("id", "cluster")), "piece").alias("bin"), F.lit(0).cast("long").alias("bin_offset"))
    return rest.unionByName(whole).withColumnRenamed("id", id_col)


def _bits(values: pd.Series, limit: int) -> list[int]:
    """A bit for each value that is there more than `limit` times; -1 for the others and null, which can't conflict."""
    code, distinct = pd.factorize(values)
    often = np.append(np.bincount(code[code >= 0], minlength=len(distinct)) > limit, False)
    return np.where(often, np.cumsum(often) - 1, -1)[code].tolist()
