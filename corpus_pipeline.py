"""Documents to packed training data: each stage calls one operator of threadloom.llm.

Every stage takes and, but for the last, returns documents with all their columns; n_chars follows the text. Columns are found by their
exact names, and others may clash with them in upper or lower case. Null texts count as empty. Rows that repeat are rows of their own
unless a stage says otherwise. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from threadloom.llm import bpe, lines, minhash, packing, substrings, toxicity
from threadloom.llm.common import Scratch, maybe_broadcast, table


def _flat(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The same rows with columns named by their place, so that no two clash, and the new name of each column's first place."""
    names: dict[str, str] = {}
    for i, c in enumerate(docs.columns):
        names.setdefault(c, f"c{i}")
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))), names


def _rest(flat: DataFrame, names: dict[str, str]) -> list[str]:
    """The columns that go along as they are, without the text and its length: a stage makes these anew, and Python needn't get them twice."""
    return [c for c in flat.columns if c not in (names["text"], names.get("n_chars"))]


def _with_text(flat: DataFrame, names: dict[str, str], columns: list[str], changed: DataFrame, text: str) -> DataFrame:
    """The carried rows with the new text, in the columns of the documents."""
    new = {names["text"]: F.col(text)}
    if "n_chars" in names:
        new[names["n_chars"]] = F.length(text).cast(flat.schema[names["n_chars"]].dataType)
    return changed.select(*(new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in flat.columns)).toDF(*columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't scored as toxic. Empty and null texts are not toxic."""
    flat, names = _flat(docs)
    field = toxicity.train(docs, table(spark, sf_dir, "labels"))
    rows = flat.select(F.struct(*flat.columns).alias("row"), F.col(names["text"]).alias("text"))
    return toxicity.score(rows, field, id_col="row").where("predicted = 0").select("row.*").toDF(*docs.columns)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that at least 10 of them have; a document that loses all stays, with an empty text."""
    flat, names = _flat(docs)
    return _with_text(flat, names, docs.columns, lines.drop_lines(flat, carry=_rest(flat, names), id_col=names["doc_id"], text_col=names["text"]), "text")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near duplicates; of rows that are equal in id and text, one. Where ids
    repeat, each text of an id is a document of its own. Rows without id stay."""
    flat, names = _flat(docs)
    id_, text = F.col(names["doc_id"]), F.col(names["text"])
    scratch = Scratch(spark, "near")
    again = scratch.keep(flat.groupBy(id_.alias("again")).count().where("count > 1").select("again"))
    repeats = again.limit(1).count() > 0
    # where ids repeat, a string for each pair of id and text, in the order of the ids; null for a null id
    number = isinstance(flat.schema[names["doc_id"]].dataType, IntegralType)
    digits = F.lpad((id_.cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string"), 20, "0") if number else id_.cast("string")
    own = flat.withColumn("_row", F.concat(digits, F.lit(" "), F.coalesce(F.sha2(text, 256), F.lit(""))) if repeats else id_)
    found = minhash.near_duplicates(own, id_col="_row", text_col=names["text"]).where("NOT kept AND _row IS NOT NULL").select(F.col("_row").alias("gone")).distinct()
    found = scratch.keep(found)
    left = own.join(maybe_broadcast(found, found.count(), 96 if repeats else 16), F.col("_row") == F.col("gone"), "left_anti").drop("_row")
    if repeats:
        same = id_.eqNullSafe(F.col("again"))
        again = maybe_broadcast(again, again.count(), 16)
        left = left.join(again, same, "left_anti").unionByName(left.join(again, same, "left_semi").dropDuplicates([names["doc_id"], names["text"]]))
    return left.toDF(*docs.columns)


def drop_repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 50 bytes that a document with a smaller id has; characters that lose bytes go as a whole, and a
    document that loses all stays, with an empty text."""
    flat, names = _flat(docs)
    return _with_text(flat, names, docs.columns, substrings.remove_repeats(flat, keep="text", carry=_rest(flat, names), id_col=names["doc_id"], text_col=names["text"]), "kept")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document, or each piece of a long one, goes in bins of 8192 tokens. Documents whose texts have become equal are a
    cluster, of which a bin holds one; a bin holds at most 16 of a source."""
    import public_tokenizers

    flat, names = _flat(docs)
    rows = flat.select(F.col(names["doc_id"]).alias("doc_id"), F.col(names["source"]).alias("source") if "source" in names else F.lit(None).cast("string").alias("source"), F.xxhash64(F.coalesce(names["text"], F.lit(""))).alias("cluster"), F.col(names["text"]).alias("text"))
    counted = bpe.token_counts(rows, public_tokenizers.path("byte_bpe_50k.json"), carry=["doc_id", "source", "cluster"])
    counted = Scratch(spark, "counted").keep(counted)  # it is read twice, and counting is dear
    return packing.pack(counted, length_col="n_tokens", cluster_col="cluster")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_common_lines),
    ("minhash_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_substrings),
    ("best_fit_packing", pack),
]

#: SQL can't express the stages; tests hold run() against the same chain in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
