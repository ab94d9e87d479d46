"""Ledger rows as a stream: redelivered rows are dropped within a watermark, the rest normalised."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.ingest import normalized


def deduplicated(stream: DataFrame, delay: str = "14 days", event_time: str = "value_date") -> DataFrame:
    """The first delivery of each source and external id; state is kept for ``delay`` of event time."""
    return normalized(stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["kind", "external_id"]))


def inflow(stream: DataFrame, width: str = "3 days", delay: str = "14 days") -> DataFrame:
    """Rows and money of each source in tumbling windows of value time."""
    w = F.window("value_date", width)
    rows = stream.withWatermark("value_date", delay).groupBy(w, "kind").agg(F.count("*").alias("rows"), F.sum("amount_minor").alias("amount_minor"))
    return rows.select(F.col("window.start").alias("window_start"), "kind", "rows", "amount_minor")
