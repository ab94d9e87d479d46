"""Append-only, hash-chained receipts.

A receipt's hash covers its payload in canonical form (keys sorted at every depth); it also names
its predecessor's hash. Verification tells edited payloads from broken links.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCHEMA = "sequence long, receipt_id string, event_type string, correlation_id string, payload string, payload_hash string, previous_hash string"
EVENTS = ("INGEST", "INGEST_UPLOAD", "RECONCILE_RUN", "HUMAN_REVIEW", "EXPORT")


def canonical(payload) -> str:
    return json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def payload_hash(payload) -> str:
    return hashlib.sha256(canonical(payload).encode()).hexdigest()


class AuditLog:
    """A single-writer log in a Parquet folder, or in memory if no path is given."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path, self._rows = spark, path, []

    def receipts(self) -> DataFrame:
        if self.path is None:
            return self.spark.createDataFrame(self._rows, SCHEMA)
        try:
            return self.spark.read.schema(SCHEMA).parquet(self.path)
        except Exception as e:  # nothing has been written yet
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], SCHEMA)
            raise

    def append(self, event_type: str, correlation_id: str, payload: dict) -> tuple[str, str]:
        tail = self.receipts().orderBy(F.desc("sequence")).limit(1).collect()
        sequence, previous = (tail[0].sequence + 1, tail[0].payload_hash) if tail else (1, None)
        digest = payload_hash(payload)
        row = (sequence, f"aud_{sequence:012d}", event_type, correlation_id, canonical(payload), digest, previous)
        if self.path is None:
            self._rows.append(row)
        else:
            self.spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
        return row[1], digest

    def latest(self, limit: int = 100) -> DataFrame:
        return self.receipts().orderBy(F.desc("sequence")).limit(min(500, max(1, limit)))

    def verify(self) -> dict:
        faults = verify_chain(self.receipts()).where("tampered or broken").orderBy("sequence").collect()
        return {
            "count": self.receipts().count(), "intact": not faults,
            "tampered": [{"sequence": r.sequence, "id": r.receipt_id} for r in faults if r.tampered],
            "breaks": [{"sequence": r.sequence, "id": r.receipt_id, "claimed": r.previous_hash, "actual": r.actual_previous} for r in faults if r.broken],
        }


def chained(events: DataFrame, order: str, payload: str, partition: str | None = None) -> DataFrame:
    """Receipts for rows that already lie in order: hash of the payload, and the one before."""
    w = (W.partitionBy(partition) if partition else W.partitionBy()).orderBy(order)
    return events.withColumn("payload_hash", F.sha2(F.col(payload), 256)).withColumn("previous_hash", F.lag("payload_hash").over(w))


STRETCH = 1 << 16


def verify_chain(receipts: DataFrame, order: str = "sequence", partition: str | None = None, stretch: int = STRETCH) -> DataFrame:
    """Adds ``actual_previous``, ``tampered`` and ``broken``. A single chain is cut into stretches of its whole-numbered order,
    each a task's; a stretch's first receipt follows the last one of the nearest stretch before, of which there is one row each."""
    if partition:
        linked = receipts.withColumn("actual_previous", F.lag("payload_hash").over(W.partitionBy(partition).orderBy(order)))
    else:
        rows = receipts.withColumn("_stretch", F.floor(F.col(order) / stretch))
        ends = rows.groupBy("_stretch").agg(F.max_by("payload_hash", order).alias("_last"))
        ends = ends.select("_stretch", F.lag("_last").over(W.orderBy("_stretch")).alias("_before"))
        within = F.lag("payload_hash").over(W.partitionBy("_stretch").orderBy(order))
        first = F.row_number().over(W.partitionBy("_stretch").orderBy(order)) == 1
        linked = rows.withColumn("_within", within).withColumn("_first", first).join(ends, "_stretch").withColumn("actual_previous", F.when(F.col("_first"), F.col("_before")).otherwise(F.col("_within")))
        linked = linked.drop("_stretch", "_within", "_first", "_before")
    return linked.withColumn("tampered", F.sha2(F.col("payload"), 256) != F.col("payload_hash")).withColumn("broken", ~F.col("previous_hash").eqNullSafe(F.col("actual_previous")))
