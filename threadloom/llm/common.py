"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Largest estimated size of a table that is broadcast, in bytes; larger ones are joined by a shuffle.
BROADCAST_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str, **renamed: str) -> DataFrame:
    """Only the named columns, found by exact spelling; other columns may clash with them or with each other."""
    wanted = {n: n for n in names} | renamed
    at = {}
    for i, c in enumerate(df.columns):
        at.setdefault(c, i)
    missing = [c for c in wanted.values() if c not in at]
    if missing:
        raise ValueError(f"no column {', '.join(missing)}")
    flat = df.toDF(*(f"_{i}" for i in range(len(df.columns))))
    return flat.select(*(F.col(f"_{at[c]}").alias(out) for out, c in wanted.items()))


class Scratch:
    """Intermediate tables in the shared folder: they cut the lineage and outlive any executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def write(self, df: DataFrame) -> str:
        self.n += 1
        path = f"{self.path}/{self.n}"
        df.write.parquet(path)
        return path

    def keep(self, df: DataFrame) -> DataFrame:
        return self.spark.read.schema(df.schema).parquet(self.write(df))

    def drop(self, df_or_path) -> None:
        """Deletes one table that no later step reads."""
        paths = [df_or_path] if isinstance(df_or_path, str) else {f.rsplit("/", 1)[0] for f in df_or_path.inputFiles()}
        jvm = self.spark.sparkContext._jvm
        for p in paths:
            at = jvm.org.apache.hadoop.fs.Path(p)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def maybe_broadcast(df: DataFrame, rows: int, row_bytes: int, most: int | None = None) -> DataFrame:
    """Broadcasts df if its counted rows fit; else leaves the join to a shuffle."""
    return F.broadcast(df) if rows * row_bytes <= (BROADCAST_BYTES if most is None else most) else df


def release_memory() -> None:
    """In a Python worker: gives freed memory back to the system, as its next task may be of another kind."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # where the C library has it
        trim(0)
