"""Human reviews as appended events; an exception's state is derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import LedgerError
from .audit import AuditLog

OUTCOMES = ("APPROVED", "REJECTED", "ESCALATED")
SCHEMA = "review_id string, exception_id string, outcome string, reviewer string, note string, sequence long"


class ReviewDesk:
    """The reviews of one run's exceptions, kept in a store if one is given."""

    def __init__(self, spark: SparkSession, exceptions: DataFrame, audit: AuditLog | None = None, store=None, run_id: str = ""):
        self.spark, self.exceptions, self.audit, self.store, self.run_id, self._rows = spark, exceptions, audit, store, run_id, []

    def reviews(self) -> DataFrame:
        if self.store is None:
            return self.spark.createDataFrame(self._rows, SCHEMA)
        rows = self.store.read("reviews").where(F.col("run_id") == self.run_id)
        fields = "exception_id string, outcome string, reviewer string, note string"
        return rows.select(F.col("id").alias("review_id"), F.from_json("body", fields).alias("b"), "sequence").select("review_id", "b.*", "sequence")

    def review(self, exception_id: str, outcome: str, reviewer: str, note: str = "") -> str:
        """Records one review: unknown exceptions and second reviews are errors."""
        if outcome not in OUTCOMES:
            raise LedgerError("VALIDATION_FAILED", f"outcome must be one of {', '.join(OUTCOMES)}")
        found = self.exceptions.where(F.col("exception_id") == exception_id).limit(1).collect()
        if not found:
            raise LedgerError("EXCEPTION_NOT_FOUND", f"No exception {exception_id}.")
        if not self.reviews().where(F.col("exception_id") == exception_id).isEmpty():
            raise LedgerError("EXCEPTION_ALREADY_RESOLVED", f"{exception_id} has been reviewed.")
        if self.store is None:
            n = len(self._rows) + 1
            made = f"rev_{n:012d}"
            self._rows.append((made, exception_id, outcome, reviewer, note, n))
        else:
            made = self.store.add("reviews", "rev", self.run_id, outcome, {"exception_id": exception_id, "outcome": outcome, "reviewer": reviewer, "note": note})
        if self.audit:
            self.audit.append("HUMAN_REVIEW", exception_id, {"exceptionId": exception_id, "outcome": outcome, "reviewer": reviewer, "amountAtRiskMinor": found[0].amount_at_risk_minor})
        return made

    def state(self) -> DataFrame:
        return with_reviews(self.exceptions, self.reviews())

    def open(self) -> DataFrame:
        return self.state().where("resolved_by_review_id is null")

    def rollup(self) -> DataFrame:
        return rollup(self.reviews(), self.exceptions)


def with_reviews(exceptions: DataFrame, reviews: DataFrame) -> DataFrame:
    """Exceptions with their first review, if any."""
    first = reviews.groupBy("exception_id").agg(F.min_by("review_id", "sequence").alias("resolved_by_review_id"), F.min_by("outcome", "sequence").alias("outcome"))
    return exceptions.join(first, "exception_id", "left")


def rollup(reviews: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Counts by outcome and the money reviewed."""
    rows = reviews.join(exceptions.select("exception_id", "amount_at_risk_minor"), "exception_id", "left")
    n = lambda o: F.count_if(F.col("outcome") == o)
    return rows.agg(F.count("*").alias("reviews"), n("APPROVED").alias("approved"), n("REJECTED").alias("rejected"), n("ESCALATED").alias("escalated"), F.coalesce(F.sum("amount_at_risk_minor"), F.lit(0)).alias("reviewed_amount_minor"))
