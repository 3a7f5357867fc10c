"""Exports of chats: JSON files with a tree of nodes per conversation, to the messages of the branch that is live.

Node messages are of mixed types, so they stay JSON text (VARIANT) until the fields that count are read.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..shared import kept
from . import export_scan

#: Content types that are shown, and the title of a conversation without one.
VISIBLE_TYPES, NO_TITLE = ["text", "multimodal_text"], "無題のConversation"


def read_elements(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Every object of the .json files (a list, one, or {"conversations": [...]}), read by many tasks: file, pos, the object as VARIANT
    (null if it is no JSON), its external_id, and why it is skipped: no_conversation (no mapping or no id), repeated (the id came
    before, by file and place), or null."""
    rows = export_scan.scan_elements(spark, paths).select("file", "pos", F.try_parse_json("text").alias("c")).withColumn("external_id", external_id(F.col("c")))
    fit = (F.col("external_id") != "") & F.try_variant_get("c", "$.mapping", "map<string,variant>").isNotNull()
    rows = rows.withColumn("fit", F.coalesce(fit, F.lit(False)))
    # the first of each id; an id of very many rows costs one row a task
    first = rows.where("fit").groupBy(F.col("external_id").alias("_id")).agg(F.min(F.struct("file", "pos")).alias("_first"))
    rows = rows.join(first, F.col("external_id") == F.col("_id"), "left")
    reason = F.when(~F.col("fit"), "no_conversation").when(F.struct("file", "pos") != F.col("_first"), "repeated")
    return rows.select("file", "pos", "c", "external_id", reason.alias("skip_reason"))


def read_exports(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Conversations of .json files: file, pos and the conversation as VARIANT. Only those with a mapping and an id; of an id that comes
    again, the first by file and place."""
    return read_elements(spark, paths).where("skip_reason IS NULL").drop("skip_reason")


def load_counts(spark: SparkSession, path: str, elements: DataFrame) -> DataFrame:
    """One row about a load: files read, files skipped for their name, elements, those skipped by reason, and conversations."""
    r = F.col("skip_reason")
    counts = elements.agg(F.count("*").alias("elements"), F.count_if(r == "no_conversation").alias("no_conversation"), F.count_if(r == "repeated").alias("repeated"), F.count_if(r.isNull()).alias("conversations"))
    both = export_scan.file_counts(spark, path).unionByName(counts, allowMissingColumns=True)
    return both.agg(*(F.sum(c).alias(c) for c in both.columns))


def external_id(c: Column) -> Column:
    get = lambda path: F.nullif(F.try_variant_get(c, path, "string"), F.lit(""))
    return F.coalesce(get("$.conversation_id"), get("$.id"), F.lit(""))


def conversations(exports: DataFrame) -> DataFrame:
    """Per conversation: external_id, title, times (seconds, null unless numbers), archived, current node and nodes."""
    get = lambda path, kind: F.try_variant_get("c", path, kind)
    number = lambda path: F.when(F.schema_of_variant(get(path, "variant")).rlike("BIGINT|DOUBLE|DECIMAL"), get(path, "double"))
    return exports.select(
        "external_id", F.coalesce(F.nullif(F.trim(get("$.title", "string")), F.lit("")), F.lit(NO_TITLE)).alias("title"), number("$.create_time").alias("created"), number("$.update_time").alias("updated"),
        F.coalesce(get("$.is_archived", "boolean"), F.lit(False)).alias("archived"), get("$.current_node", "string").alias("current_node"), get("$.mapping", "map<string,variant>").alias("nodes"),
    )


@F.pandas_udf(ArrayType(StringType()))
def branch_ids(current: pd.Series, parents: pd.Series) -> pd.Series:
    """Node ids from the root to the current node; stops at an unknown node or one seen before. parents: [[node, parent]...]."""

    def walk(at, pairs) -> list[str]:
        of, out, seen = {p["id"]: p["parent"] for p in pairs} if pairs is not None else {}, [], set()
        while at is not None and at in of and at not in seen:
            seen.add(at)
            out.append(at)
            at = of[at]
        return out[::-1]

    return pd.Series([walk(a, p) for a, p in zip(current, parents, strict=True)])


def live_branch(convs: DataFrame) -> DataFrame:
    """The nodes of each live branch, in order: external_id, pos, node_id, node."""
    parents = F.transform(F.map_entries("nodes"), lambda e: F.struct(e["key"].alias("id"), F.try_variant_get(e["value"], "$.parent", "string").alias("parent")))
    rows = convs.withColumn("ids", branch_ids("current_node", parents))
    return rows.select("external_id", F.posexplode("ids").alias("pos", "node_id"), "nodes").select("external_id", "pos", "node_id", F.element_at("nodes", F.col("node_id")).alias("node"))


def branch_by_joins(edges: DataFrame) -> DataFrame:
    """The same by joins, for (conv, node, parent, is_current) rows: conv, node, depth from the current node.

    Each round the nodes found so far are looked up in pointers that are twice as long as in the round before, so the rounds grow with
    the logarithm of the longest branch. A node is one row of a conversation: rows that repeat are one. A branch ends at an
    unknown node or one seen before; a conversation of several current nodes has the branch of each.
    """
    node = edges.select("conv", "node", "parent").distinct()
    known = node.select("conv", F.col("node").alias("parent")).distinct()
    up = kept(node.where("node IS NOT NULL").join(known, ["conv", "parent"], "left_semi").select("conv", "node", F.col("parent").alias("to")), "up")
    found = kept(edges.where("is_current").select("conv", F.col("node").alias("start"), "node", F.lit(0).alias("depth")).distinct(), "branch")
    step = 1
    while True:
        more = found.join(up, ["conv", "node"]).select("conv", "start", F.col("to").alias("node"), F.col("depth") + step)
        after = kept(found.union(more).groupBy("conv", "start", "node").agg(F.min("depth").alias("depth")), "branch")
        if not after.where(F.col("depth") >= step).limit(1).count():
            return after.select("conv", "node", "depth")
        found, step = after, 2 * step
        up = kept(up.alias("a").join(up.alias("b"), (F.col("a.conv") == F.col("b.conv")) & (F.col("a.to") == F.col("b.node"))).select("a.conv", "a.node", "b.to"), "up")


def visible_messages(branch: DataFrame) -> DataFrame:
    """The user's and the assistant's messages with text: role, content, attachments; the others as skipped = true."""
    get = lambda path, kind: F.try_variant_get("node", path, kind)
    parts = F.coalesce(get("$.message.content.parts", "array<variant>"), F.array().cast("array<variant>"))
    is_text = lambda p: F.schema_of_variant(p) == "STRING"
    field = lambda p, k: F.when(F.schema_of_variant(F.try_variant_get(p, f"$.{k}", "variant")) == "STRING", F.try_variant_get(p, f"$.{k}", "string"))
    texts = F.transform(parts, lambda p: F.when(is_text(p), F.try_variant_get(p, "$", "string")).otherwise(F.coalesce(field(p, "text"), F.lit(""))))
    content = F.array_join(F.filter(texts, lambda t: t != ""), "\n")
    kind = lambda p: F.coalesce(field(p, "content_type"), F.lit(""))
    assets = F.filter(parts, lambda p: ~is_text(p) & (field(p, "asset_pointer").isNotNull() | kind(p).contains("image") | kind(p).contains("asset")))
    one = "struct<id:string,name:string,mime_type:string,size:bigint>"
    meta = F.coalesce(get("$.message.metadata.attachments", f"array<{one}>"), F.array().cast(f"array<{one}>"))
    both = F.concat(
        F.transform(meta, lambda a: F.struct(a["id"].alias("id"), F.lit(None).cast("string").alias("asset_pointer"), a["name"].alias("name"), a["mime_type"].alias("mime_type"), a["size"].alias("size"))),
        F.transform(assets, lambda p: F.struct(F.lit(None).cast("string").alias("id"), field(p, "asset_pointer").alias("asset_pointer"), field(p, "name").alias("name"), field(p, "mime_type").alias("mime_type"), F.try_variant_get(p, "$.size", "bigint").alias("size"))),
    )
    role, type_ = get("$.message.author.role", "string"), get("$.message.content.content_type", "string")
    shown = role.isin("user", "assistant") & type_.isin(VISIBLE_TYPES) & (F.regexp_replace(content, r"(?U)\s", "") != "")
    rows = branch.where(get("$.message", "variant").isNotNull())
    return rows.select(
        "external_id", "pos", role.alias("role"), content.alias("content"), F.coalesce(get("$.message.id", "string"), get("$.id", "string")).alias("source_message_id"),
        get("$.message.create_time", "double").alias("created"), type_.alias("content_type"), both.alias("attachments"), (~F.coalesce(shown, F.lit(False))).alias("skipped"),
    )
