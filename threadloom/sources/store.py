"""A store of several tables in which a run shows as a whole or not at all.

Tables are plain Parquet. Each row carries the run that wrote it, and a run becomes visible by one row in the table of finished runs,
written last. Readers take rows of finished runs only, so what an interrupted run left behind is never seen, and the run can be
repeated. A deletion is a row too: it hides rows of earlier runs that agree with it in the named columns, so that one run can replace rows.
A store has one writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..shared import kept
from .sinks import existing

_RUNS, _GONE = "run string, no long, attempt string, counts map<string,long>", "name string, by string, key string, attempt string"


def _key(columns: list[str]) -> Column:
    return F.to_json(F.struct(*(F.col(c).cast("string").alias(c) for c in columns)))


class Store:
    """keys: the key columns of each table; schemas: the tables' columns; references: (parent, child, column): the child has the parent's
    only key in that column and goes with it."""

    def __init__(self, spark: SparkSession, root: str, keys: dict[str, list[str]], schemas: dict[str, StructType], references: list[tuple[str, str, str]] = ()):
        self.spark, self.root, self.keys, self.schemas, self.references = spark, root, keys, schemas, list(references)

    def _table(self, path: str, schema: StructType | str) -> DataFrame:
        return existing(self.spark, f"{self.root}/{path}", self.spark.createDataFrame([], schema))

    def runs(self) -> DataFrame:
        return self._table("finished_runs", _RUNS)

    def _ways(self, name: str) -> list[list[str]]:
        """The columns by which rows of a table can be deleted: its key, and each reference."""
        ways = [self.keys[name], *([c] for _, child, c in self.references if child == name)]
        return [w for i, w in enumerate(ways) if w not in ways[:i]]

    def read(self, name: str) -> DataFrame:
        """The rows of finished runs that no later run deleted."""
        schema = self.schemas[name]
        runs = self.runs().select("attempt", "no")
        rows = self._table(name, StructType([*schema.fields, StructField("attempt", StringType())])).join(runs, "attempt")
        gone = self._table("deletions", _GONE).where(F.col("name") == name).join(runs, "attempt")
        for way in self._ways(name):
            late = gone.where(F.col("by") == ",".join(way)).groupBy("key").agg(F.max("no").alias("gone_no"))  # the last deletion decides
            rows = rows.withColumn("key", _key(way)).join(late, "key", "left").where(F.coalesce(F.col("no") >= F.col("gone_no"), F.lit(True))).drop("key", "gone_no")
        return rows.select(*schema.names)

    def commit(self, run: str, inserts: dict[str, DataFrame], gone: dict[str, tuple[DataFrame, list[str]]] | None = None, order: dict[str, list[str]] | None = None) -> dict[str, int]:
        """Deletes rows, by table: (rows, the columns that must agree), and adds rows whose key isn't there then, of equal keys the first by
        `order` (else by the table's columns). Returns the rows added to each table. A run that is finished isn't repeated: its counts are told."""
        done = self.runs().where(F.col("run") == run).select("counts").first()
        if done:
            return done.counts
        attempt, no = uuid.uuid4().hex, (self.runs().agg(F.max("no")).first()[0] or 0) + 1
        hidden = {n: (kept(rows.select(*by).distinct(), "gone"), by) for n, (rows, by) in (gone or {}).items()}
        counts = {}
        for name, rows in inserts.items():
            keys, names = self.keys[name], self.schemas[name].names
            there = self.read(name)
            if name in hidden:
                there = there.join(*hidden[name], "left_anti")
            by = [F.col(c) for c in (order or {}).get(name, names)]
            first = F.row_number().over(Window.partitionBy(*keys).orderBy(*by))
            new = rows.select(*names).withColumn("_n", first).where("_n = 1").drop("_n").join(there.select(*keys), keys, "left_anti").select(*names)
            new = kept(new, "rows")
            counts[name] = new.count()
            new.withColumn("attempt", F.lit(attempt)).write.mode("append").parquet(f"{self.root}/{name}")
        for name, (rows, by) in hidden.items():
            rows.select(F.lit(name).alias("name"), F.lit(",".join(by)).alias("by"), _key(by).alias("key"), F.lit(attempt).alias("attempt")).write.mode("append").parquet(f"{self.root}/deletions")
        self.spark.createDataFrame([(run, no, attempt, counts)], _RUNS).coalesce(1).write.mode("append").parquet(f"{self.root}/finished_runs")
        return counts

    def replace(self, run: str, name: str, by: str, replaced: DataFrame, rows: DataFrame) -> dict[str, int]:
        """New rows in place of all that the listed values of a column have; a value without new rows loses its rows."""
        return self.commit(run, {name: rows}, {name: (replaced, [by])})

    def _walk(self, start: str) -> list[tuple[str, str, str]]:
        """The references below a table, each after those of its parent."""
        order, reached = [], [start]
        for parent in reached:
            for edge in self.references:
                if edge[0] == parent:
                    order.append(edge)
                    if edge[1] not in reached:
                        reached.append(edge[1])
        return sorted(order, key=lambda e: self._depth(e[0], start))

    def _depth(self, name: str, start: str) -> int:
        return 0 if name == start else 1 + max((self._depth(p, start) for p, c, _ in self.references if c == name), default=-1)

    def cascade(self, run: str, name: str, gone: DataFrame) -> dict[str, int]:
        """Deletes the rows with the given keys, and all that refers to them, in one run. Returns how many rows go from each table; a finished
        run deletes nothing more."""
        if self.runs().where(F.col("run") == run).limit(1).count():
            return {}
        lost = {name: kept(self.read(name).join(gone.select(*self.keys[name]).distinct(), self.keys[name], "left_semi").select(*self.keys[name]), "lost")}
        for parent, child, column in self._walk(name):
            below = self.read(child).join(lost[parent].select(F.col(self.keys[parent][0]).alias(column)), column, "left_semi").select(*self.keys[child])
            lost[child] = kept((lost[child].unionByName(below) if child in lost else below).distinct(), "lost")
        counts = {n: df.count() for n, df in lost.items()}
        self.commit(run, {}, {n: (df, self.keys[n]) for n, df in lost.items()})
        return counts

    def orphans(self) -> DataFrame:
        """(parent, child, n): rows of each reference whose parent isn't there; there should be none."""
        out = [self.read(child).where(F.col(column).isNotNull()).join(self.read(parent).select(F.col(self.keys[parent][0]).alias(column)), column, "left_anti").agg(F.lit(parent).alias("parent"), F.lit(child).alias("child"), F.count("*").alias("n")) for parent, child, column in self.references]
        first, *rest = out
        for df in rest:
            first = first.unionByName(df)
        return first
