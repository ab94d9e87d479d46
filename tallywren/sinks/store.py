"""Tables that outlive a service: Parquet folders under one path, to which rows are only appended."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.reconcile import Run
from ..schema import STORED

# The tables of small rows, which hold one JSON document each beside their keys.
SMALL = "sequence long, id string, run_id string, kind string, body string"
RUN_TABLES = ("matches", "members", "exceptions", "unresolved", "candidates")


class Store:
    """One writer at a time; any number of readers. Small rows are numbered in order of writing."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def has(self, name: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._at(name))
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def append(self, name: str, rows: DataFrame, *partition: str) -> None:
        rows.write.mode("append").partitionBy(*partition).parquet(self._at(name))

    def read(self, name: str, schema=None) -> DataFrame:
        if not self.has(name):
            return self.spark.createDataFrame([], schema or SMALL)
        return (self.spark.read.schema(schema) if schema is not None else self.spark.read).parquet(self._at(name))

    # records

    def add_records(self, rows: DataFrame) -> None:
        have = set(rows.columns)
        self.append("records", rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in STORED)))

    def records(self) -> DataFrame:
        return self.read("records", STORED)

    # small rows

    def add(self, table: str, prefix: str, run_id: str, kind: str, body: dict) -> str:
        sequence = (self.read(table).agg(F.max("sequence")).first()[0] or 0) + 1
        row_id = f"{prefix}_{sequence:012d}"
        self.append(table, self.spark.createDataFrame([(sequence, row_id, run_id, kind, json.dumps(body, sort_keys=True))], SMALL).coalesce(1))
        return row_id

    def latest(self, table: str, limit: int, run_id: str | None = None, kind: str | None = None) -> list[dict]:
        """The newest rows first, with their keys beside their fields."""
        rows = self.read(table)
        if run_id is not None:
            rows = rows.where(F.col("run_id") == run_id)
        if kind is not None:
            rows = rows.where(F.col("kind") == kind)
        return [json.loads(r.body) | {"id": r.id, "run_id": r.run_id, "kind": r.kind, "sequence": r.sequence} for r in rows.orderBy(F.desc("sequence")).limit(limit).collect()]

    # runs

    def add_run(self, run: Run) -> None:
        """A run's tables, partitioned by run so that runs coexist."""
        tables = {"matches": run.matches, "members": run.members, "exceptions": run.exceptions, "unresolved": run.unresolved, "candidates": run.candidate_sample()}
        for name in RUN_TABLES:
            self.append(name, tables[name].withColumn("run_id", F.lit(run.run_id)), "run_id")

    def run_table(self, name: str, run_id: str) -> DataFrame:
        return self.read(name).where(F.col("run_id") == run_id)

    def load_run(self, run: Run) -> Run:
        """Gives a run its stored tables instead of computing them."""
        for name in ("matches", "members", "exceptions", "unresolved"):
            run.__dict__[name] = self.run_table(name, run.run_id)
        run.__dict__["membership"], run.__dict__["match_heads"] = run.members, run.matches
        return run
