"""Stored JSON payloads and report files, read strictly: what breaks a rule is null, not half a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType


def _fits(value: Column, schema, required: set[str], path: str = "") -> Column:
    """Whether each required field below is there, in every element of every array."""
    ok = F.lit(True)
    if isinstance(schema, StructType):
        for f in schema.fields:
            at, name = value[f.name], f"{path}{f.name}"
            if name in required:
                ok = ok & at.isNotNull()
            if isinstance(f.dataType, (StructType, ArrayType)):
                ok = ok & (at.isNull() | _fits(at, f.dataType, required, name + "."))
    elif isinstance(schema, ArrayType) and isinstance(schema.elementType, StructType):
        ok = F.forall(value, lambda e: e.isNotNull() & _fits(e, schema.elementType, required, path))
    return F.coalesce(ok, F.lit(False))


def parse_strict(payload: Column, schema: StructType, required: set[str], enums: dict[str, list[str]] | None = None, only: list[str] | None = None) -> Column:
    """The payload, or null if a required field (dotted path) is missing or of another type anywhere, a top-level field
    has another value than its enum allows, or (only) there are other top-level keys."""
    value = F.from_json(payload, schema)
    ok = F.try_parse_json(payload).isNotNull() & _fits(value, schema, required)
    for name, allowed in (enums or {}).items():
        ok = ok & (value[name].isNull() | value[name].isin(allowed))
    if only is not None:
        ok = ok & (F.size(F.array_except(F.json_object_keys(payload), F.array(*map(F.lit, only)))) == 0)
    return F.when(ok, value)


def read_report(spark: SparkSession, path: str, schema: StructType, required: list[str]) -> DataFrame:
    """A report file; arrays that are missing are empty, but those required must be there."""
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    for f in schema.fields:
        if isinstance(f.dataType, ArrayType):
            empty = F.raise_error(F.lit(f"the report has no {f.name}")).cast(f.dataType) if f.name in required else F.array().cast(f.dataType)
            rows = rows.withColumn(f.name, F.coalesce(f.name, empty))
    return rows


def label_failures(labels: DataFrame, classes: tuple[str, ...] = ("A", "B", "C", "D")) -> DataFrame:
    """Rows of a calibration fixture that break a rule: blank ref, unknown class, or a ref that comes again."""
    again = labels.groupBy("candidate_ref").count().where("count > 1").select("candidate_ref", F.lit("duplicate_candidate_ref").alias("reason"))
    reason = F.when(F.trim(F.coalesce("candidate_ref", F.lit(""))) == "", "blank_candidate_ref").when(~F.coalesce(F.col("class").isin(*classes), F.lit(False)), "invalid_class")
    return labels.select("candidate_ref", reason.alias("reason")).where("reason IS NOT NULL").unionByName(again)


def has_attachments(json: Column) -> Column:
    return F.coalesce(F.json_array_length(json) > 0, F.lit(False))
